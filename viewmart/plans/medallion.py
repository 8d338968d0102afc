"""Whole-layer jobs: bronze in, silver and gold tables out."""

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewmart.fixed_values import AS_OF, CONTENT_KEYS
from viewmart.plans.billing import gold_billing
from viewmart.plans.content import gold_content
from viewmart.plans.operations import gold_operations
from viewmart.plans.silver import silver_customers, silver_logs, silver_tickets
from viewmart.session import scratch
from viewmart.sources.bronze_csv import bad_value_counts, find_formats, observe_bad_values, read_bronze_csv
from viewmart.sources.formats import chosen_formats
from viewmart.sources.layers import read_layer, write_layer

SILVER_TABLES = ["customers", "tickets", "viewing_logs"]
GOLD_TABLES = ["billing_segmentation", "content_strategy", "network_operations"]
#: The order of rows in clustered gold: the dashboards' filters or the cells' keys, then what tells rows apart.
GOLD_ORDER = {
    "billing_segmentation": ["Region", "Customer_Segment", "Customer_ID"],
    "content_strategy": CONTENT_KEYS,
    "network_operations": ["Equipment_Model", "Department", "Ticket_ID"],
}


def take_in(
    spark: SparkSession, csv_paths: dict[str, str], base: str, multi_line: bool = False, find: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Parse CSV files once and store them typed: (stored tables, cells per table and column that did not fit).

    Unreadable cells are counted while a table is written. ``find`` looks first how each
    table's files write dates and numbers, in one more pass.
    """
    stored, counted = {}, spark.createDataFrame([], "Table_Name string, Column_Name string, Bad_Values long")
    for table, path in csv_paths.items():
        formats = chosen_formats(find_formats(spark, path, table, multi_line)) if find else None
        bronze, observed = observe_bad_values(read_bronze_csv(spark, path, table, multi_line, formats))
        stored[table] = write_layer(bronze, base, "bronze", table)
        counted = counted.unionByName(observed().withColumn("Table_Name", F.lit(table)))
    return stored, counted


def run_bronze(
    spark: SparkSession, csv_paths: dict[str, str], base: str, multi_line: bool = False, find: bool = False
) -> dict[str, DataFrame]:
    """The stored tables of ``take_in``."""
    return take_in(spark, csv_paths, base, multi_line, find)[0]


def unreadable_values(bronze: dict[str, DataFrame]) -> DataFrame:
    """Cells per table and column that did not fit the declared type."""
    parts = [bad_value_counts(df).select(F.lit(table).alias("Table_Name"), "*") for table, df in bronze.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def run_unreadable(
    bronze: dict[str, DataFrame], base: str, limit: int | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Write the counts of unreadable cells beside bronze; more than ``limit`` in all are an error.

    Without ``counted``, what ``take_in`` found, bronze is read for them.
    """
    first = next(iter(bronze.values()))
    stored = write_layer(unreadable_values(bronze) if counted is None else counted, base, "bronze", "unreadable_values")
    total = stored.agg(F.coalesce(F.sum("Bad_Values"), F.lit(0))).first()[0]
    if limit is not None and total > limit:
        raise ValueError(f"{total} cells or records could not be read, more than {limit}; see {base}/bronze/unreadable_values")
    return read_layer(first.sparkSession, base, "bronze", "unreadable_values")


def run_silver(
    bronze: dict[str, DataFrame], base: str, as_of: date = AS_OF, csv_copy: bool = False
) -> dict[str, DataFrame]:
    """Clean each bronze table given and write it; returns the stored tables."""
    clean = {
        "customers": lambda df: silver_customers(df, as_of),
        "tickets": silver_tickets,
        "viewing_logs": silver_logs,
    }
    stored = {}
    for table, df in bronze.items():
        with scratch(df.sparkSession):
            stored[table] = write_layer(clean[table](df), base, "silver", table, csv_copy)
    return stored


def run_gold(
    spark: SparkSession,
    base: str,
    as_of: date = AS_OF,
    csv_copy: bool = False,
    tables: list[str] | None = None,
    clustered: bool = False,
    files: int | None = None,
    silver_base: str | None = None,
) -> dict[str, DataFrame]:
    """Build gold tables from stored silver ones; billing needs both customers and tickets.

    ``clustered`` stores rows in ``GOLD_ORDER``, so that ``read_chosen`` skips files. The last step of a table,
    lookups and row rules, then runs twice, since its order is found by a pass of its own. ``silver_base``
    names where silver is stored, if not below ``base``.
    """

    def silver(table: str) -> DataFrame:
        return read_layer(spark, silver_base or base, "silver", table)

    build = {
        "billing_segmentation": lambda: gold_billing(silver("customers"), silver("tickets"), as_of),
        "content_strategy": lambda: gold_content(silver("viewing_logs")),
        "network_operations": lambda: gold_operations(silver("tickets")),
    }
    stored = {}
    for table in tables or GOLD_TABLES:
        with scratch(spark):
            gold = build[table]()
            if clustered:
                stored[table] = write_layer(gold, base, "gold", table, csv_copy, GOLD_ORDER[table], files)
            else:
                stored[table] = write_layer(gold, base, "gold", table, csv_copy)
    return stored


def run_all(
    spark: SparkSession, bronze: dict[str, DataFrame], base: str, as_of: date = AS_OF, csv_copy: bool = False
) -> dict[str, DataFrame]:
    run_silver(bronze, base, as_of, csv_copy)
    return run_gold(spark, base, as_of, csv_copy)


def load_gold(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All gold tables, or an error that names the missing one."""
    return {table: read_layer(spark, base, "gold", table) for table in GOLD_TABLES}


@contextmanager
def cached(*tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Hold tables in the cluster's cache for a batch of dashboard queries."""
    held = tuple(table.cache() for table in tables)
    try:
        yield held
    finally:
        for table in held:
            table.unpersist()


def _as_text(name: str, kind: str) -> Column:
    """A value as text that does not depend on the engine; fractions count to four digits."""
    if kind == "double":
        return F.round(F.col(name) * 10_000).cast("decimal(38,0)").cast("string")
    return F.col(name).cast("string")


def _looked_up(texts: list[str], place: Column) -> Column:
    """The first 32 bits of the MD5 of the text at ``place``, from a constant table."""
    bits = [str(int(hashlib.md5(text.encode()).hexdigest()[:8], 16)) for text in texts]
    return F.get(F.split(F.lit(",".join(bits)), ",").cast("array<bigint>"), place.cast("int"))


#: Whole numbers, and fractions in halves, below this are looked up: scores, counts, hours and ratings mostly are such.
_SMALL = 256


def _bits(name: str, kind: str) -> Column:
    """The first 32 bits of the MD5 of a value's text."""
    value = F.col(name)
    bits = F.conv(F.substring(F.md5(_as_text(name, kind).cast("binary")), 1, 8), 16, 10).cast("long")
    small = value.between(0, _SMALL)
    if kind == "boolean":
        return F.when(value.isNotNull(), _looked_up(["false", "true"], value))
    if kind in ("int", "bigint"):
        return F.when(small, _looked_up([str(i) for i in range(_SMALL + 1)], value)).otherwise(bits)
    if kind == "double":  # as whole ten-thousandths
        halves = _looked_up([str(i * 5_000) for i in range(2 * _SMALL + 1)], value * 2)
        return F.when(small & (value * 2 == F.floor(value * 2)), halves).otherwise(bits)
    return bits


def contents(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column: rows, values that are not NULL, and a checksum that knows no order.

    The checksum adds up the first 32 bits of each value's MD5. One scan of each table.
    """
    parts = []
    for table, df in tables.items():
        columns = [(name, kind) for name, kind in df.dtypes if not name.startswith("_") and name != "ingest_seq"]
        measures = [F.count("*").alias("rows")]
        for i, (name, kind) in enumerate(columns):
            bits = F.coalesce(F.sum(_bits(name, kind)), F.lit(0).cast("long"))
            measures += [F.count(name).alias(f"n{i}"), bits.alias(f"c{i}")]
        each = [
            F.struct(F.lit(name).alias("Column_Name"), F.col("rows").alias("Row_Count"), F.col(f"n{i}").alias("Non_Null"), F.col(f"c{i}").alias("Checksum"))
            for i, (name, _) in enumerate(columns)
        ]
        row = df.agg(*measures)
        parts.append(row.select(F.lit(table).alias("Table_Name"), F.explode(F.array(*each)).alias("v")).select("Table_Name", "v.*"))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total
