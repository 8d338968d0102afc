"""Table and query definitions."""
