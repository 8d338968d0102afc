"""Connected components of a link table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from viewmart.llm.common import settle


def _mark(links: DataFrame) -> tuple:
    """Equal for equal link tables; one row comes to the driver."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _smallest(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a``, combined before the shuffle."""
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _smallest(both).withColumn("low", F.least("low", "a"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = _smallest(links)
    moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """(node, component) for every node of a link: the smallest node that links reach.

    Links have no direction. NULL ends, links of a node to itself and repeated links change
    nothing. The number of steps grows with the logarithm of the longest path. Each step's
    links are written to the shared folder, so lineage stays short.
    """
    a, b = F.col(source), F.col(target)
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), a.isNull().alias("x"), b.isNull().alias("y"))
    links = settle(links.where("not x and not y and a <> b").select("a", "b").distinct(), "links")
    before = _mark(links)
    while before[0]:
        links = settle(_small_star(_large_star(links)), "links")
        now = _mark(links)
        if now == before:
            break
        before = now
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
