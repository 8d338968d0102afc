"""Bronze CSV files in, typed tables out."""

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from viewmart.functions import null_tokens_to_null
from viewmart.operators import existing
from viewmart.schemas import bronze_names, bronze_schema
from viewmart.sources.formats import read_as, scan_formats

_BAD = "_bad_columns"
_BROKEN = "_broken_record"
#: What a record with too few or too many cells is counted under.
RECORD = "(record)"


def _typed(text: Column, kind: DataType, written: str | None = None) -> Column:
    text = null_tokens_to_null(text)
    if written is not None:
        return read_as(text, kind, written)
    if isinstance(kind, StringType):
        return text
    if kind.typeName() in ("long", "integer"):
        # A file may hold whole numbers as 12.0 when their column also has gaps.
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, list[str]]:
    shape = {"header": True, "enforceSchema": False, "escape": '"', "multiLine": multi_line}
    names = spark.read.csv(path, inferSchema=False, **shape).columns
    texts = StructType([StructField(name, StringType()) for name in [*names, _BROKEN]])
    return spark.read.csv(path, schema=texts, columnNameOfCorruptRecord=_BROKEN, mode="PERMISSIVE", **shape), names


def find_formats(spark: SparkSession, path: str, table: str, multi_line: bool = False) -> DataFrame:
    """How the files write dates and numbers, see ``scan_formats``; ``chosen_formats`` settles it."""
    raw, _ = _raw_csv(spark, path, multi_line)
    return scan_formats(raw, bronze_schema(table))


def read_bronze_csv(
    spark: SparkSession, path: str, table: str, multi_line: bool = False, formats: Mapping[str, str] | None = None
) -> DataFrame:
    """The bronze table with declared types, plus two technical columns.

    Columns go by the names in the header: any order will do, optional ones may be missing,
    and unknown ones stay text. All files of a path must have the same header.
    ``ingest_seq`` orders rows as they stand in the files, across splits. ``_bad_columns``
    names the columns whose text is neither a "no value" token nor of the declared type;
    those cells are NULL. It also names ``(record)`` for a record with too few or too many cells.

    ``multi_line`` allows line breaks in quoted cells; a file is then read by one task. Without
    it such a record is split, and its parts are counted as broken. ``formats`` names the way in which
    a column's dates or numbers are written, where it is not that of ISO.
    """
    raw, names = _raw_csv(spark, path, multi_line)
    formats = formats or {}
    declared = {field.name: field.dataType for field in bronze_schema(table)}
    kinds = {name: declared.get(name, StringType()) for name in names}
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    raw = raw.select("*", place.alias("ingest_seq"))
    bad = [
        F.when(null_tokens_to_null(F.col(name)).isNotNull() & _typed(F.col(name), kind, formats.get(name)).isNull(), name)
        for name, kind in kinds.items()
        if not isinstance(kind, StringType)
    ]
    bad.append(F.when(F.col(_BROKEN).isNotNull(), RECORD))
    return raw.select(
        *[_typed(F.col(name), kind, formats.get(name)).alias(name) for name, kind in kinds.items()],
        "ingest_seq",
        F.array_compact(F.array(*bad)).alias(_BAD),
    )


def bad_value_counts(bronze: DataFrame) -> DataFrame:
    """How many cells per column could not be read as the declared type."""
    return (
        bronze.select(F.explode(_BAD).alias("Column_Name"))
        .groupBy("Column_Name")
        .agg(F.count("*").alias("Bad_Values"))
        .orderBy("Column_Name")
    )


def observe_bad_values(bronze: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The same rows, and a function that gives ``bad_value_counts`` of them without another pass.

    The counts are taken by the first action that reads all rows, such as the write of the table; calling
    the function before waits for it. Columns without unreadable cells are left out.
    """
    spark, seen = bronze.sparkSession, Observation()
    names = [name for name in bronze.columns if name not in ("ingest_seq", _BAD)] + [RECORD]
    counts = [F.count_if(F.array_contains(_BAD, name)).alias(f"bad{i}") for i, name in enumerate(names)]

    def observed() -> DataFrame:
        got = seen.get
        rows = [(name, got[f"bad{i}"]) for i, name in enumerate(names) if got[f"bad{i}"]]
        return spark.createDataFrame(rows, "Column_Name string, Bad_Values long")

    return bronze.observe(seen, *counts), observed


def write_csv(df: DataFrame, path: str) -> None:
    """Export with a header; texts with commas or quotes are quoted."""
    writer = df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    writer.csv(path, header=True, escape='"')


def bronze_only(df: DataFrame, table: str) -> DataFrame:
    """The bronze columns the table has, in their usual order."""
    return df.select(existing(df, bronze_names(table)))
