"""Silver from several loads against silver from one."""

import pytest
from pyspark.sql import functions as F

from fixtures import star_schema
from viewmart.operators import quantile_values
from viewmart.plans import incremental, silver
from viewmart.sources.layers import layer_path, read_layer

SMALL = "/root/testdata/sf0.001"
FULL = {"customers": silver.silver_customers, "tickets": silver.silver_tickets, "viewing_logs": silver.silver_logs}
KEYS = {"customers": "Customer_ID", "tickets": "Ticket_ID", "viewing_logs": "Log_ID"}


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("table", list(FULL))
def test_loads_add_up_to_the_same_table(spark, tmp_path, table):
    bronze, base = star_schema.BRONZE[table](spark, SMALL), str(tmp_path)
    if table == "customers":
        first, second = F.col("ingest_seq") <= 150, F.col("ingest_seq") <= 151
    else:
        first, second = F.col(KEYS[table]) % 7 < 3, F.col(KEYS[table]) % 7 < 3
    incremental.load_increment(bronze.where(first), base, table, 1)
    incremental.load_increment(bronze.where(second & ~first), base, table, 2)
    last = bronze.where(~second)
    found = incremental.load_increment(last, base, table, 3)
    assert rows_of(found) == rows_of(FULL[table](bronze)) and incremental.loads_of(spark, base, table) == 3
    # A load that is taken in twice counts once.
    again = incremental.load_increment(last, base, table, 3)
    assert rows_of(again) == rows_of(read_layer(spark, base, "silver", table)) == rows_of(found)
    with pytest.raises(ValueError, match="cannot follow"):
        incremental.load_increment(last, base, table, 5)


def test_a_load_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    bronze, base = star_schema.BRONZE["tickets"](spark, SMALL), str(tmp_path)
    first = F.col("Ticket_ID") % 2 == 0
    incremental.load_increment(bronze.where(first), base, "tickets", 1)
    before = rows_of(read_layer(spark, base, "silver", "tickets"))
    failing = bronze.where(~first).withColumn("Status", F.when(F.col("Ticket_ID") % 40 == 1, F.raise_error(F.lit("midway"))).otherwise(F.col("Status")))
    with pytest.raises(Exception, match="midway"):
        incremental.load_increment(failing, base, "tickets", 2)
    assert incremental.loads_of(spark, base, "tickets") == 1 and rows_of(read_layer(spark, base, "silver", "tickets")) == before
    found = incremental.load_increment(bronze.where(~first), base, "tickets", 2)
    assert rows_of(found) == rows_of(silver.silver_tickets(bronze))


def test_weighted_quantiles(spark):
    values = [1.5] * 7 + [2.25] * 2 + [-4.0] * 5 + [1e9]
    counted = spark.createDataFrame([(v, values.count(v)) for v in set(values)] + [(None, 3)], "x double, n long")
    whole = spark.createDataFrame([(v,) for v in values], "x double")
    fractions = {"a": 0.1, "b": 0.5, "c": 0.77}
    assert quantile_values(counted, "x", fractions, weight="n") == quantile_values(whole, "x", fractions)
    assert layer_path("/b", "s", "t") == "/b/s/t"
