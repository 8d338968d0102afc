"""Operators against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewmart.operators import (
    any_of, attach_lookup, exact_quantiles, existing, histogram, impute, keep_first, most_common, quantile_values, unique_names,
    value_counts, where_in, with_globals,
)
from viewmart.session import settle


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- quantiles ---------------------------------------------------------------------------


def sample(kind):
    rng = random.Random(7)
    return {
        "uniform": [rng.uniform(-50, 250) for _ in range(999)],
        "two digits": [round(rng.uniform(50, 250), 2) for _ in range(500)] + [6000.0, 7000.0],
        "one value holds a third": [42.0] * 400 + [rng.gauss(0, 1e6) for _ in range(800)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(301)],
        "close together": [1 + i * 2**-52 for i in range(257)],
        "ties": [1.0, 1.0, 2.0, 2.0, 2.0, 3.0],
        "zeros": [0.0, -0.0, 0.0, 5e-324, -5e-324],
        "one": [3.25],
        "infinite": [-math.inf, 1.0, 2.0, 3.0, math.inf],
        "all infinite": [math.inf] * 3,
    }[kind]


@pytest.mark.parametrize(
    "kind",
    ["uniform", "two digits", "one value holds a third", "wide", "close together", "ties", "zeros", "one", "infinite", "all infinite"],
)
def test_quantiles_are_exact(spark, kind):
    values = sample(kind)
    df = frame(spark, [(v,) for v in values] + [(None,)] * 3, "x double").repartition(3)
    fractions = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0, "odd": 0.9173}
    row = exact_quantiles(df, "x", fractions).collect()
    assert len(row) == 1
    at_once = quantile_values(df, "x", fractions)
    ordered = sorted(values)
    for name, fraction in fractions.items():
        place = fraction * (len(ordered) - 1)
        low, high, part = ordered[math.floor(place)], ordered[math.ceil(place)], place - math.floor(place)
        expected = low if low == high else (1 - part) * low + part * high
        assert math.isclose(row[0][name], expected, rel_tol=1e-12, abs_tol=1e-320), (name, row[0][name], expected)
        assert math.isclose(at_once[name], expected, rel_tol=1e-12, abs_tol=1e-320), (name, at_once[name], expected)


@pytest.mark.parametrize("rows", [[], [(None,), (None,)], [(math.nan,)]])
def test_quantiles_of_nothing(spark, rows):
    df = frame(spark, rows, "x double")
    assert exact_quantiles(df, "x", {"q": 0.5}).collect()[0].q is None
    assert quantile_values(df, "x", {"q": 0.5}) == {"q": None}


def test_quantiles_read_nothing_ahead(spark):
    """No job runs while the plan is built, and no size picks another one."""
    df = frame(spark, [(1.0,), (math.inf,), (2.0,)], "x double").where(F.raise_error(F.lit("read")).isNull())
    exact_quantiles(df, "x", {"q": 0.5})


def test_a_pass_ends_when_every_rank_is_found(spark):
    """Few distinct values are found in one pass, which reads the column once."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = frame(spark, [(float(i % 5),) for i in range(400)], "x double").mapInArrow(seen, "x double")
    assert quantile_values(df, "x", {"low": 0.25, "mid": 0.5}) == {"low": 1.0, "mid": 2.0} and reads.value == 400


# --- joins to per-key tables -------------------------------------------------------------


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_attach_lookup_keeps_every_fact(spark, threshold):
    rng = random.Random(3)
    keys = ["hot"] * 300 + [f"k{rng.randrange(40)}" for _ in range(500)] + [None] * 20 + ["unknown"] * 5
    facts = frame(spark, [(i, k) for i, k in enumerate(keys)], "id int, key string")
    known = facts.where("key is not null and key <> 'unknown'")
    lookup = settle(
        known.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).select("key", "last", "n"), "lookup"
    )
    lookup = lookup.drop("n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        ours = attach_lookup(facts, lookup, "key").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last = {row.key: row.last for row in lookup.collect()}
    assert sorted((r.id, r.key, r.last) for r in ours if r.key) == [(i, k, last.get(k)) for i, k in enumerate(keys) if k]
    assert sum(r.key is None and r.last is None for r in ours) == 20


def test_attach_lookup_splits_a_hot_key(spark):
    """Without a broadcast, the adaptive join reads the hot key's partition in parts."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        facts = spark.range(0, 60_000, 1, 8).select(
            "id", F.when(F.col("id") % 3 > 0, "Unassigned").otherwise((F.col("id") % 500).cast("string")).alias("key")
        )
        lookup = settle(facts.groupBy("key").agg(F.max("id").alias("last")), "hot-lookup")
        joined = attach_lookup(facts, lookup, "key")
        assert joined.count() == 60_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# --- the rest ----------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_keep_first(spark, parts):
    rows = [(1, 10, "a"), (1, 5, "b"), (2, 1, "c"), (None, 9, "d"), (None, 3, "e"), (3, 2, "f"), (3, 2 + 10**9, "g")]
    df = frame(spark, rows, "k int, seq bigint, v string").repartition(parts)
    assert sorted(r.v for r in keep_first(df, "k", "seq").collect()) == ["b", "c", "e", "f"]


def test_keep_first_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = keep_first(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1)
    assert plan.index("Exchange hashpartitioning") < partial


def test_impute_mean_and_median(spark):
    df = frame(spark, [(1, 1.0, 10), (2, None, 20), (3, 4.0, None), (4, 100.0, 40)], "i int, a double, b int")
    rows = impute(df, means=("b",), medians=("a",)).orderBy("i").collect()
    assert [r.a for r in rows] == [1.0, 4.0, 4.0, 100.0]
    assert [r.b for r in rows] == [10.0, 20.0, pytest.approx(70 / 3), 40.0]
    assert rows[0].asDict().keys() == {"i", "a", "b"}


def test_impute_all_missing_stays_missing(spark):
    df = frame(spark, [(None, None)], "a double, b double")
    assert impute(df, means=("a",), medians=("b",)).collect()[0].asDict() == {"a": None, "b": None}


def test_with_globals_has_no_window(spark):
    df = spark.range(10)
    plan = with_globals(df, df, most=F.max("id"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan


def test_value_counts_orders_and_drops_null(spark):
    df = frame(spark, [("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "v string")
    assert [tuple(r) for r in value_counts(df, "v", "w").collect()] == [("a", 2), ("b", 2), ("c", 1)]


def test_most_common_takes_smallest_of_ties(spark):
    rows = [("g", "HD"), ("g", "4K"), ("g", "HD"), ("g", "4K"), ("h", "SD"), ("h", None), ("h", None), (None, "HD"), ("n", None)]
    df = frame(spark, rows, "k string, q string")
    assert {tuple(r) for r in most_common(df, "k", "q", "m").collect()} == {("g", "4K"), ("h", "SD")}


def test_histogram_edges(spark):
    df = frame(spark, [(v,) for v in (0, 4, 5, 99, 100, None)], "x int")
    rows = histogram(df, "x", 20, 0, 100).collect()
    assert [(r.Bin, r.Count) for r in rows] == [(0, 2), (1, 1), (19, 2)]
    assert rows[1].Bin_Start == 5.0 and rows[1].Bin_End == 10.0 and rows[0].Mean == pytest.approx(41.6)


def test_histogram_keeps_values_beyond_limits_and_own_range(spark):
    df = frame(spark, [(-7,), (3,), (17,)], "x int")
    assert [(r.Bin, r.Count) for r in histogram(df, "x", 2, 0, 10).collect()] == [(0, 2), (1, 1)]
    assert [(r.Bin, r.Count) for r in histogram(df, "x", 4).collect()] == [(0, 1), (1, 1), (3, 1)]
    same = frame(spark, [(5,), (5,)], "x int")
    assert [(r.Bin, r.Count) for r in histogram(same, "x", 4).collect()] == [(0, 2)]


def test_filters_and_guards(spark):
    df = frame(spark, [("a", 1), ("b", 2)], "g string, x int")
    assert where_in(df, ("missing",), g=[], missing=["z"]).count() == 2
    with pytest.raises(ValueError, match="no column missing"):
        where_in(df, missing=["z"])
    gaps = frame(spark, [("a",), (None,), ("b",)], "g string")
    assert {r.g for r in where_in(gaps, g=["a", None]).collect()} == {"a", None}
    assert [r.g for r in where_in(gaps, g=[None]).collect()] == [None]
    assert [r.x for r in where_in(df, g=["b"], x=[2, 3]).collect()] == [2]
    assert existing(df, ["x", "y", "g"]) == ["x", "g"]
    assert unique_names(["a", "b", "a"]) == ["a", "b"]
    row = df.agg(any_of(df, "x", F.avg, 4.0).alias("p"), any_of(df, "y", F.avg, 4.0).alias("q")).collect()[0]
    assert (row.p, row.q) == (1.5, 4.0)
