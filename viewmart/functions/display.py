"""KPI texts as the dashboards show them."""

from pyspark.sql import Column, functions as F


def number_text(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def money_text(value: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, digits))


def plain_text(value: Column, digits: int) -> Column:
    """Fixed digits without thousands separators."""
    return F.format_string(f"%.{digits}f", value)


def rating_text(value: Column) -> Column:
    return F.concat(plain_text(value, 2), F.lit("/5.0"))
