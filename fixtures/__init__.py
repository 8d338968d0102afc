"""What the tests and the registered queries run on: bronze tables derived from the star-schema tables."""
