"""Frequency tables."""

from pyspark.sql import DataFrame, functions as F


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows per value, most frequent first; NULL is not a value."""
    name = name or column
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(name))
        .agg(F.count("*").alias("Count"))
        .orderBy(F.desc("Count"), name)
    )


def most_common(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """The most frequent non-NULL value per key, the smallest of tied ones.

    Counting (key, value) pairs first keeps the per-key state to one candidate, where
    ``mode`` would hold every distinct value of a key at once.
    """
    pairs = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key, column).agg(
        F.count("*").alias("_n")
    )
    best = pairs.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_best"))
    return best.select(key, F.col("_best.v").alias(name))


def histogram(
    df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Rows per equal-width bin, with the column's mean on every row.

    Without limits the column's own minimum and maximum are used. The last bin includes its
    upper edge; values beyond given limits count in the outer bins. Empty bins are left out.
    """
    x = F.col(column).cast("double")
    present = df.select(x.alias("x")).where(F.col("x").isNotNull())
    limits = present.agg(
        (F.lit(float(low)) if low is not None else F.min("x")).alias("low"),
        (F.lit(float(high)) if high is not None else F.max("x")).alias("high"),
        F.avg("x").alias("Mean"),
    )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("low"), width)), F.lit(0).cast("long"))
    placed = present.crossJoin(F.broadcast(limits)).select(
        F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int").alias("Bin"), "low", width.alias("width"), "Mean"
    )
    return (
        placed.groupBy("Bin", "low", "width", "Mean")
        .agg(F.count("*").alias("Count"))
        .select(
            "Bin",
            (F.col("low") + F.col("Bin") * F.col("width")).alias("Bin_Start"),
            (F.col("low") + (F.col("Bin") + 1) * F.col("width")).alias("Bin_End"),
            "Count",
            "Mean",
        )
        .orderBy("Bin")
    )
