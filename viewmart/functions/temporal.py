"""Date and time expressions."""

from datetime import date

from pyspark.sql import Column, functions as F


def days_until(day: Column, as_of: date) -> Column:
    """Days from the reporting date to ``day``; negative when it has passed."""
    return F.date_diff(day, F.lit(as_of))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two zone-less timestamps, whatever the session's time zone."""
    gap = end - start
    seconds = F.extract(F.lit("SECOND"), gap).cast("double")
    for unit, length in (("DAY", 86_400), ("HOUR", 3_600), ("MINUTE", 60)):
        seconds = seconds + F.extract(F.lit(unit), gap) * F.lit(length)
    return seconds


def elapsed_hours(start: Column, end: Column) -> Column:
    return elapsed_seconds(start, end) / F.lit(3600.0)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days, rounded down: 12 hours backwards is day -1."""
    return F.floor(elapsed_seconds(start, end) / F.lit(86400.0))
