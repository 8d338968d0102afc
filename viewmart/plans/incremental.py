"""Silver from bronze that arrives in loads: a stored state takes each load in, old files are not read again.

The state of a table holds what its cleaning rules need of all rows:

- ``values``: how often each value of a column with a median or mean stands in it. Counts of two loads add
  up, and exact medians and means follow from them alone.
- ``rows``: the rows cleaned by every rule that looks at one row, with the imputed columns still NULL
  where they were; of customers, the first row of each id.

Both are published tables, so a load that fails leaves the state as it was. Silver is then the stored
rows with the gaps filled from the counts, which is the same table that one full load gives.
"""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from viewmart.fixed_values import AS_OF
from viewmart.functions.numeric import exact
from viewmart.operators import keep_first, quantile_values
from viewmart.plans.silver import customer_rows, log_rows, ticket_rows
from viewmart.sources.layers import layer_path, layer_version, publish, read_layer, write_layer

#: Where the state lies, beside the layers.
STATE = "silver_state"

#: Per table: the rules of one row, columns filled with the mean, columns filled with the median.
RULES: dict[str, tuple[Callable[[DataFrame, date], DataFrame], tuple[str, ...], tuple[str, ...]]] = {
    "customers": (customer_rows, (), ("Monthly_Bill",)),
    "tickets": (lambda df, as_of: ticket_rows(df), ("Signal_Strength_dBm",), ("Customer_Satisfaction_Rating",)),
    "viewing_logs": (lambda df, as_of: log_rows(df), ("Buffering_Events",), ("User_Rating",)),
}


def value_counts_of(bronze: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(Column_Name, Value, Row_Count) of the values that are not NULL; counted before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("Column_Name"), F.col(c).cast("double").alias("Value")) for c in columns]))
    values = bronze.select(pairs.alias("pair")).select("pair.*").where(F.col("Value").isNotNull())
    return values.groupBy("Column_Name", "Value").agg(F.count("*").alias("Row_Count"))


def counted_mean(counts: DataFrame, column: str) -> float | None:
    """The mean of a column, from its counted values; the same as over its rows in any order."""
    value = exact(F.col("Value"))
    total = F.try_divide(F.sum(value * F.col("Row_Count").cast("decimal(18,0)")).cast("double"), F.sum(F.when(value.isNotNull(), F.col("Row_Count"))))
    return counts.where(F.col("Column_Name") == column).agg(total).first()[0]


def _filled(rows: DataFrame, counts: DataFrame, means: tuple[str, ...], medians: tuple[str, ...]) -> DataFrame:
    fills = {name: counted_mean(counts, name) for name in means}
    for name in medians:
        own = counts.where(F.col("Column_Name") == name)
        fills[name] = quantile_values(own, "Value", {name: 0.5}, weight="Row_Count")[name]
    return rows.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(fill).cast("double")) for name, fill in fills.items()})


def loads_of(spark: SparkSession, base: str, table: str) -> int:
    """How many loads the state of a table has taken in; loads are numbered from 1 on."""
    return layer_version(spark, base, STATE, f"{table}_log")


def load_increment(new: DataFrame, base: str, table: str, load: int, as_of: date = AS_OF) -> DataFrame:
    """Take one load of bronze into the state of ``table`` and publish its silver; returns the stored silver.

    ``load`` numbers the loads from 1 on. Within a load ``ingest_seq`` orders customers, and earlier loads
    come first. A load that the state has taken in already is not counted twice: only silver is
    published again. A gap in the numbers is an error. A load without rows counts as a load.
    """
    spark = new.sparkSession
    _, means, medians = RULES[table]
    done = loads_of(spark, base, table)
    if not 1 <= load <= done + 1:
        raise ValueError(f"load {load} of {table} cannot follow load {done}")
    if load == done + 1:
        _take_in(new, base, table, load, as_of)
    loads = range(1, loads_of(spark, base, table) + 1)
    rows = _together([read_layer(spark, base, STATE, f"{table}_rows_{n}") for n in loads])
    counts = _together([read_layer(spark, base, STATE, f"{table}_values_{n}") for n in loads])
    counts = counts.groupBy("Column_Name", "Value").agg(F.sum("Row_Count").alias("Row_Count"))
    if table == "customers":
        rows = keep_first(rows, "Customer_ID", "_seq").drop("_seq")
    return write_layer(_filled(rows, counts, means, medians), base, "silver", table)


def _take_in(new: DataFrame, base: str, table: str, load: int, as_of: date) -> None:
    """Rows and counts of a load are tables of their own; the entry in the log, which comes last, makes them count.

    So a load that fails half way is simply done again, and no earlier load is read or written.
    """
    clean, means, medians = RULES[table]
    write_layer(value_counts_of(new, means + medians), base, STATE, f"{table}_values_{load}")
    rows = new
    if table == "customers":
        first = keep_first(new, "Customer_ID", "ingest_seq")
        rows = first.withColumn("_seq", F.struct(F.lit(load).alias("load"), F.col("ingest_seq").alias("seq")))
    rows = clean(rows, as_of).drop("ingest_seq", "_bad_columns")
    write_layer(rows, base, STATE, f"{table}_rows_{load}")
    # Its version is the number of loads. One job at a time takes in loads of a table; of two the slower fails here.
    publish(new.sparkSession.range(load, load + 1).withColumnRenamed("id", "load"), layer_path(base, STATE, f"{table}_log"))


def _together(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
