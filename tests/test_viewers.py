"""Sketches of viewers against exact numbers."""

import pytest
from pyspark.sql import functions as F

from viewmart import fixed_values as fv
from viewmart.plans import viewers


@pytest.fixture(scope="module")
def logs(spark):
    """40,000 viewers, a hot one, and cells that share most of theirs."""
    rows = spark.range(200_000, numPartitions=4)
    cell = {
        "Program_Genre": F.concat(F.lit("g"), F.col("id") % 3), "Channel_Name": F.concat(F.lit("c"), F.col("id") % 5),
        "Device_Type": F.concat(F.lit("d"), F.col("id") % 2), "Stream_Quality": F.when(F.col("id") % 100 != 99, "HD"),
    }
    viewer = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 50 == 7, None).otherwise((F.col("id") * 7919) % 40_000)
    return rows.select(F.col("id").alias("Log_ID"), viewer.alias("Customer_ID"), *[c.alias(n) for n, c in cell.items()]).cache()


@pytest.mark.parametrize("by", [[], ["Program_Genre"], ["Device_Type", "Channel_Name"]])
@pytest.mark.parametrize("chosen", [{}, {"genres": ["g1", "g2"]}, {"devices": ["d0"], "genres": ["g1"]}])
def test_united_sketches_are_within_their_bound(spark, logs, by, chosen):
    sketches = viewers.viewer_sketches(logs)
    estimate = {tuple(r[k] for k in by): r for r in viewers.estimated_viewers(sketches, by, **chosen).collect()}
    exact = {tuple(r[k] for k in by): r for r in viewers.exact_viewers(logs, by, **chosen).collect()}
    assert set(estimate) == set(exact) and exact
    for key, row in exact.items():
        assert estimate[key].Total_Views == row.Total_Views
        assert abs(estimate[key].Distinct_Viewers - row.Distinct_Viewers) <= 1 + viewers.RELATIVE_ERROR * row.Distinct_Viewers


def test_viewers_are_not_counted_twice(spark, logs):
    cells = viewers.viewer_sketches(logs).withColumn("n", F.hll_sketch_estimate("Viewer_Sketch"))
    added = cells.agg(F.sum("n")).first()[0]
    assert viewers.estimated_viewers(cells).first().Distinct_Viewers < 0.6 * added


def test_nothing_chosen(spark, logs):
    sketches = viewers.viewer_sketches(logs)
    assert viewers.estimated_viewers(sketches, genres=["none"]).first().Distinct_Viewers == 0
    assert viewers.exact_viewers(logs, genres=["none"]).first().Distinct_Viewers == 0
    assert viewers.estimated_viewers(sketches.where("false"), ["Program_Genre"]).count() == 0
    alone = logs.withColumn("Customer_ID", F.lit(None).cast("long"))
    assert {r.Distinct_Viewers for r in viewers.estimated_viewers(viewers.viewer_sketches(alone), fv.CONTENT_KEYS).collect()} == {0}
