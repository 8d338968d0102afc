"""Published versions, failed jobs and reloads."""

import os

import pytest
from pyspark.sql import functions as F

from viewmart.operators import where_in
from viewmart.sources import layers
from viewmart.sources.layers import PublishConflict, layer_path, layer_version, publish, read_chosen, read_layer, write_layer
from viewmart.sources.reload import LayerCache


def numbers(df):
    return sorted(row.id for row in df.collect())


def test_a_failed_job_leaves_the_old_table(spark, tmp_path):
    base = str(tmp_path)
    write_layer(spark.range(5), base, "gold", "t")
    failing = spark.range(100, numPartitions=4).withColumn("id", F.when(F.col("id") == 90, F.raise_error(F.lit("midway"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="midway"):
        write_layer(failing, base, "gold", "t")
    assert numbers(read_layer(spark, base, "gold", "t")) == [0, 1, 2, 3, 4] and layer_version(spark, base, "gold", "t") == 1
    # The next job succeeds, and clears what the failed one left.
    write_layer(spark.range(2), base, "gold", "t")
    left = [name for name in os.listdir(layer_path(base, "gold", "t")) if name.startswith("v")]
    assert numbers(read_layer(spark, base, "gold", "t")) == [0, 1] and len(left) == 2


def test_a_table_can_be_built_from_itself(spark, tmp_path):
    base = str(tmp_path)
    write_layer(spark.range(3), base, "gold", "t")
    write_layer(read_layer(spark, base, "gold", "t").selectExpr("id + 10 AS id"), base, "gold", "t")
    assert numbers(read_layer(spark, base, "gold", "t")) == [10, 11, 12]


def test_old_versions_are_kept_for_a_while(spark, tmp_path):
    base = str(tmp_path)
    for n in (1, 2, 3, 4):
        write_layer(spark.range(n), base, "gold", "t")
    assert numbers(read_layer(spark, base, "gold", "t", 3)) == [0, 1, 2] and len(numbers(read_layer(spark, base, "gold", "t"))) == 4
    with pytest.raises(FileNotFoundError, match="no version 1"):
        read_layer(spark, base, "gold", "t", 1)
    assert not [name for name in os.listdir(f"{base}/gold/t/log") if "draft" in name]


def test_one_of_two_jobs_at_once_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    publish(spark.range(1), path)
    first = layers._entries
    seen = first(spark, path)
    publish(spark.range(2), path)
    monkeypatch.setattr(layers, "_entries", lambda *_: seen)  # as a job sees it that began before
    with pytest.raises(PublishConflict):
        publish(spark.range(9), path)
    monkeypatch.setattr(layers, "_entries", first)
    assert numbers(read_layer(spark, str(tmp_path), ".", "t")) == [0, 1]


def test_plain_folders_are_read(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/gold/t")
    assert numbers(read_layer(spark, str(tmp_path), "gold", "t")) == [0, 1, 2] and layer_version(spark, str(tmp_path), "gold", "t") == 0
    os.makedirs(f"{tmp_path}/gold/begun/v{1:020d}-x")
    with pytest.raises(FileNotFoundError, match="begun"):
        read_layer(spark, str(tmp_path), "gold", "begun")


def test_cache_sees_a_new_version_after_expiry_or_clear(spark, tmp_path):
    base, now = str(tmp_path), [0.0]
    cache = LayerCache(spark, base, seconds=300, clock=lambda: now[0])
    with pytest.raises(FileNotFoundError, match="build the gold layer first"):
        cache.get("t")
    write_layer(spark.range(1), base, "gold", "t")
    first = cache.get("t")
    assert numbers(first) == [0] and first.storageLevel.useMemory
    write_layer(spark.range(2), base, "gold", "t")
    now[0] = 299.0
    assert cache.get("t") is first
    now[0] = 301.0
    second = cache.get("t")
    assert numbers(second) == [0, 1] and not first.storageLevel.useMemory
    now[0] = 700.0
    assert cache.get("t") is second  # expired, but of the same version
    write_layer(spark.range(3), base, "gold", "t")
    assert cache.get("t") is second
    cache.clear()
    assert numbers(cache.get("t")) == [0, 1, 2] and not second.storageLevel.useMemory


def regions(spark):
    """A third of the rows in one region, and NULL among them."""
    region = F.when(F.col("id") % 3 == 0, "EAST").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("r"), F.col("id") % 20))
    return spark.range(3000).withColumn("Region", region).withColumn("Segment", F.concat(F.lit("s"), F.col("id") % 4)).repartition(7)


def test_clustered_tables_skip_files(spark, tmp_path):
    base, rows = str(tmp_path), regions(spark)
    stored = write_layer(rows, base, "gold", "t", cluster_by=["Region", "Segment", "id"], files=12)
    assert sorted(stored.columns) == ["Region", "Segment", "id"] and numbers(stored) == list(range(3000))
    every = len(read_layer(spark, base, "gold", "t").inputFiles())
    cases = [{"Region": ["r5"]}, {"Region": ["EAST"], "Segment": ["s1"]}, {"Region": [None]}, {"Region": [None, "r7"], "id": [7, 8]}]
    for choices in cases:
        got = read_chosen(spark, base, "gold", "t", **choices)
        assert numbers(got) == numbers(where_in(rows, **choices)) != []
        assert len(got.inputFiles()) < every / 2 and got.columns == stored.columns
    assert read_chosen(spark, base, "gold", "t", Region=["nowhere"]).collect() == []
    # The frequent region is split among files, in the order of the last column.
    assert 3 <= len(read_chosen(spark, base, "gold", "t", Region=["EAST"]).inputFiles())
    assert numbers(read_chosen(spark, base, "gold", "t", Region=None)) == list(range(3000))


def test_ranges_sort_groups_of_texts_only(spark):
    data = [("f" if i % 3 else "g", None if i % 7 == 0 else f"r{i % 4}", i if i % 5 else None, f"s{i % 2}") for i in range(200)]
    data += [("empty", None, None, None)]
    df = spark.createDataFrame(data, "file_name string, region string, id bigint, segment string").repartition(3)
    columns = ["region", "segment", "id"]
    found = layers._ranges(df, columns)
    expected = []
    for name in ("f", "g", "empty"):
        row = [name]
        for k in (1, 3, 2):
            values = [r[k] for r in data if r[0] == name]
            held = [v for v in values if v is not None]
            row += [min(held, default=None), max(held, default=None), len(values) - len(held)]
        expected.append(tuple(row))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert found.columns == ["file_name", *[f"{side}{i}" for i in range(3) for side in ("low", "high", "nulls")]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortAggregate") < plan.index("HashAggregate(")  # rows go through a hash, only groups are sorted


def test_clustered_rows_stand_in_order(spark, tmp_path):
    write_layer(regions(spark), str(tmp_path), "gold", "t", cluster_by=["Region", "id"], files=6)
    stored = read_layer(spark, str(tmp_path), "gold", "t").select("_metadata.file_name", "Region", "id").collect()
    files = {}
    for row in stored:  # one task reads a small file as it stands
        files.setdefault(row.file_name, []).append((row.Region is not None, row.Region or "", row.id))
    in_files = [key for name in sorted(files) for key in files[name]]
    assert in_files == sorted(in_files) and len(files) == 6


def test_choices_of_tables_that_are_not_clustered(spark, tmp_path):
    base = str(tmp_path)
    regions(spark).write.parquet(f"{base}/gold/plain")
    write_layer(regions(spark), base, "gold", "loose")
    write_layer(regions(spark).where("false"), base, "gold", "empty", cluster_by=["Region"])
    for table, count in (("plain", 1000), ("loose", 1000), ("empty", 0)):
        assert read_chosen(spark, base, "gold", table, Region=["EAST"]).count() == count
    with pytest.raises(FileNotFoundError):
        read_chosen(spark, base, "gold", "none", Region=["EAST"])
