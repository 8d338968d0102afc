"""How a file writes its dates and numbers, found from all its cells.

Each column is read in every known way by one aggregate over the whole table. The way that leaves the
fewest cells unread is chosen; a second one that reads as many cells to other values makes the column ambiguous
(``03/04/2024`` throughout), which a person has to settle.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, StructType, TimestampNTZType

from viewmart.functions import null_tokens_to_null

# Patterns of dates, in the order in which ties are settled. Days and months may have one digit.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy"]
# Decimal point or decimal comma, each with the other one between thousands.
NUMBER_FORMATS = ["1,234.5", "1.234,5"]

_TIME = r"[ T]+(\d{1,2}:\d{2}.*)$"
_COMMA_GROUPS = r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"
_COMMA_NUMBER = r"^[+-]?(\d{1,3}(\.\d{3})+|\d+)(,\d*)?([eE][+-]?\d+)?$"


def _date(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def _timestamp(text: Column, pattern: str) -> Column:
    """A date as the pattern has it, then perhaps a time; no zone takes part."""
    day = _date(F.regexp_replace(text, _TIME, ""), pattern).cast("string")
    time = F.regexp_extract(text, _TIME, 1)
    return F.concat(day, F.when(time != "", F.concat(F.lit(" "), time)).otherwise("")).try_cast("timestamp_ntz")


def _number(text: Column, style: str) -> Column:
    if style == NUMBER_FORMATS[0]:
        return F.when(text.rlike(_COMMA_GROUPS), F.replace(text, F.lit(","), F.lit(""))).otherwise(text).try_cast("double")
    return F.when(text.rlike(_COMMA_NUMBER), F.translate(text, ",.", ".")).try_cast("double")


def formats_of(kind: DataType) -> list[str]:
    """The known formats of a type; none for types that are written in one way only."""
    if isinstance(kind, (DateType, TimestampNTZType)):
        return DATE_FORMATS
    return NUMBER_FORMATS if isinstance(kind, DoubleType) else []


def read_as(text: Column, kind: DataType, pattern: str) -> Column:
    """The value of a cell by one format; NULL where it does not fit."""
    text = F.btrim(text)
    if isinstance(kind, DateType):
        return _date(F.regexp_replace(text, _TIME, ""), pattern)
    return _timestamp(text, pattern) if isinstance(kind, TimestampNTZType) else _number(text, pattern)


def scan_formats(raw: DataFrame, schema: StructType) -> DataFrame:
    """A row for each column and format: (Column_Name, Format, Cells, Unread, Chosen, Ambiguous).

    ``raw`` holds text; "no value" texts are not cells. ``Ambiguous`` is the same on all rows of a
    column. A column without cells goes with its first format. One pass over the table.
    """
    tried = [(f, way) for f in schema if f.name in raw.columns for way in formats_of(f.dataType)]
    if not tried:
        raise ValueError("none of the columns can be written in several ways")
    measures = []
    for i, (field, way) in enumerate(tried):
        text = null_tokens_to_null(F.col(f"`{field.name}`"))
        value = read_as(text, field.dataType, way)
        mark = F.when(value.isNotNull(), F.xxhash64(value).cast("decimal(20,0)"))
        measures += [F.count(text).alias(f"n{i}"), F.count(value).alias(f"r{i}"), F.coalesce(F.sum(mark), F.lit(0)).cast("string").alias(f"m{i}")]
    each = [
        F.struct(
            F.lit(field.name).alias("Column_Name"), F.lit(way).alias("Format"), F.lit(i).alias("place"),
            F.col(f"n{i}").alias("Cells"), (F.col(f"n{i}") - F.col(f"r{i}")).alias("Unread"), F.col(f"m{i}").alias("mark"),
        )
        for i, (field, way) in enumerate(tried)
    ]
    ways = raw.agg(*measures).select(F.inline(F.array(*each)))
    column = Window.partitionBy("Column_Name")  # a handful of formats
    best = F.min(F.struct("Unread", "place", "mark")).over(column)
    ways = ways.withColumn("best", best)
    rival = (F.col("Unread") == F.col("best.Unread")) & (F.col("mark") != F.col("best.mark"))
    return ways.select(
        "Column_Name", "Format", "Cells", "Unread",
        (F.col("place") == F.col("best.place")).alias("Chosen"),
        F.max(rival & (F.col("Unread") < F.col("Cells"))).over(column).alias("Ambiguous"),
    )


def chosen_formats(report: DataFrame, stated: Mapping[str, str] | None = None) -> dict[str, str]:
    """Column name to format: the stated one, else the one found. An ambiguous column must be stated."""
    stated = dict(stated or {})
    found = report.where("Chosen").select("Column_Name", "Format", "Ambiguous").collect()  # a row for each column
    unsettled = sorted(row.Column_Name for row in found if row.Ambiguous and row.Column_Name not in stated)
    if unsettled:
        raise ValueError(f"more than one format reads {', '.join(unsettled)}; state which one holds")
    return {row.Column_Name: row.Format for row in found} | stated
