"""CSV in, layer tables out."""

import os

import pytest
from pyspark.sql import functions as F

from viewmart import fixed_values as fv
from viewmart.plans import audits, billing, content, dash_billing, medallion, operations
from viewmart.functions import exact_avg
from viewmart.schemas import bronze_names
from viewmart.session import scratch, settle, shared_dir
from fixtures import star_schema
from fixtures.registry import tables
from viewmart.sources import bronze_csv, layers

SMALL = "/root/testdata/sf0.001"
HEADER = ",".join(name for name, _ in fv.CUSTOMER_COLUMNS)


def line(**changes):
    cells = dict(
        Customer_ID="1", Name="ann", Email="e", Phone="p", Address='"1 a st, ""b"""', City="c", State="s", Zip_Code="00501",
        Subscription_Type="t", Service_Tier="v", Monthly_Bill="10.5", Join_Date="2024-01-02", Payment_Status="Paid",
        Region="r", Contract_End="2027-01-01", Age_Group="18-25", Employment_Status="e", Customer_Lifetime_Value="1e3",
        Loyalty_Points="12.0", Churn_Risk="Low", Number_Of_Devices="3", Has_Outdoor_Dish="True", Auto_Pay_Enabled="False",
        Paperless_Billing="true", Last_Payment_Date="2026-03-01",
    )
    return ",".join({**cells, **changes}[name] for name, _ in fv.CUSTOMER_COLUMNS)


def write(folder, *files):
    for i, lines in enumerate(files):
        (folder / f"part{i}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    return str(folder)


def test_csv_types_tokens_and_quotes(spark, tmp_path):
    path = write(tmp_path, [line(), line(Customer_ID="2", Phone="NA", Monthly_Bill="", Join_Date="None", Address="x")])
    rows = bronze_csv.read_bronze_csv(spark, path, "customers").orderBy("Customer_ID").collect()
    assert rows[0].Address == '1 a st, "b"' and rows[0].Zip_Code == "00501"
    assert (rows[0].Loyalty_Points, rows[0].Customer_Lifetime_Value, rows[0].Has_Outdoor_Dish) == (12, 1000.0, True)
    assert (rows[1].Phone, rows[1].Monthly_Bill, rows[1].Join_Date) == (None, None, None)
    assert rows[0]._bad_columns == [] and rows[1]._bad_columns == []


def test_csv_counts_unreadable_cells(spark, tmp_path):
    path = write(tmp_path, [line(Monthly_Bill="ten"), line(Join_Date="31/31/2020", Monthly_Bill="?"), line()])
    bronze = bronze_csv.read_bronze_csv(spark, path, "customers")
    assert [tuple(r) for r in bronze_csv.bad_value_counts(bronze).collect()] == [("Join_Date", 1), ("Monthly_Bill", 2)]
    assert medallion.unreadable_values({"customers": bronze}).count() == 2


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "Status,Ticket_ID,Customer_ID,Resolution_Time_Hrs,Equipment_Model,Issue_Category,Technician_Assigned,"
        "Signal_Strength_dBm,Extra\nCLOSED,7,1,5,mini,billing,,-60,x\nopen,8,1,9,mini,billing,joe,NA,NA\n"
    )
    bronze = medallion.run_bronze(spark, {"tickets": str(tmp_path / "t.csv")}, str(tmp_path / "lake"))
    out = medallion.run_silver(bronze, str(tmp_path / "lake"))["tickets"].orderBy("Ticket_ID").collect()
    assert [(r.Ticket_ID, r.Status, r.Technician_Assigned, r.Signal_Strength_dBm, r.Extra) for r in out] == [
        (7, "Closed", "Unassigned", -60.0, "x"), (8, "Open", "Joe", -60.0, None),
    ]
    gold = medallion.run_gold(spark, str(tmp_path / "lake"), tables=["network_operations"])["network_operations"]
    assert gold.count() == 2 and "Department" not in gold.columns


def test_first_row_in_file_order_survives(spark, tmp_path):
    files = [[line(Name=f"first {i}", Customer_ID=str(i)) for i in range(50)], [line(Name=f"later {i}", Customer_ID=str(i)) for i in range(50)]]
    path = write(tmp_path, *files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        bronze = bronze_csv.read_bronze_csv(spark, path, "customers")
        assert bronze.rdd.getNumPartitions() > 4
        stored = medallion.run_silver({"customers": bronze}, str(tmp_path / "lake"))["customers"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.Name[:5] for r in stored.collect()} == {"First"} and stored.count() == 50


def test_csv_round_trip(spark, tmp_path):
    for table, build in star_schema.BRONZE.items():
        df = bronze_csv.bronze_only(build(spark, SMALL), table)
        bronze_csv.write_csv(df, str(tmp_path / table))
        back = bronze_csv.bronze_only(bronze_csv.read_bronze_csv(spark, str(tmp_path / table), table), table)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_csv_to_gold(spark, tmp_path):
    paths = {}
    for table, build in star_schema.BRONZE.items():
        df = build(spark, SMALL)
        paths[table] = str(tmp_path / "in" / table)
        df = df.orderBy("ingest_seq").coalesce(1) if "ingest_seq" in df.columns else df
        bronze_csv.write_csv(df.select(bronze_names(table)), paths[table])
    base = str(tmp_path / "lake")
    bronze = medallion.run_bronze(spark, paths, base)
    gold = medallion.run_all(spark, bronze, base, csv_copy=True)
    assert {name: df.count() for name, df in gold.items()}["billing_segmentation"] == 150
    again = medallion.load_gold(spark, base)
    assert again["billing_segmentation"].columns == fv.GOLD_BILLING
    copy = spark.read.csv(f"{base}/gold/billing_segmentation_csv", header=True)
    assert copy.count() == 150 and copy.columns == fv.GOLD_BILLING
    names = {r.Name[:3] for r in again["billing_segmentation"].collect()}
    assert names == {"Cus"}  # the first copy of a repeated customer, never the later "Dup"
    with medallion.cached(again["billing_segmentation"]) as (held,):
        assert held.is_cached and dash_billing.financial_kpis(held).collect()[0].Active_Customers == 150
    assert not held.is_cached


def test_missing_layer_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build the gold layer first"):
        layers.read_layer(spark, str(tmp_path), "gold", "nothing")


def test_write_layer_replaces(spark, tmp_path):
    layers.write_layer(spark.range(5), str(tmp_path), "gold", "t")
    assert layers.write_layer(spark.range(2), str(tmp_path), "gold", "t").count() == 2


def test_duplicate_audit(spark):
    rows = [(1, "a", 1.0), (1, "b", None), (2, "a", 1.0), (2, "a", 1.0), (3, "x", 1.0), (4, None, None), (4, None, None)]
    df = spark.createDataFrame(rows, "Customer_ID bigint, Name string, Monthly_Bill double")
    out = {tuple(r) for r in audits.duplicate_customers(df).collect()}
    assert out == {(1, 2, True, True), (2, 2, False, False), (4, 2, False, False)}


def test_orphan_audit_counts_missing_ids(spark):
    customers = spark.createDataFrame([(1,), (None,)], "Customer_ID bigint")
    facts = spark.createDataFrame([(1,), (2,), (2,), (None,)], "Customer_ID bigint")
    out = {tuple(r) for r in audits.orphans(customers, {"t": facts}).collect()}
    assert out == {("t", 2, 2), ("t", None, 1)}


def test_category_variants(spark):
    df = spark.createDataFrame([("Open", "x"), ("OPEN", "x"), ("closed", None)], "a string, b string")
    out = {tuple(r) for r in audits.category_variants({"t": (df, ["a", "b", "missing"])}).collect()}
    assert out == {("t", "a", 3, 2), ("t", "b", 1, 1)}


def test_null_rates(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert {tuple(r) for r in audits.null_rates({"t": df}).collect()} == {("t", "a", 0.5), ("t", "b", 1.0)}


def test_filters_without_choice_keep_all(spark):
    gold = spark.createDataFrame([("r1", "s1"), ("r2", "s2")], "Region string, Customer_Segment string")
    assert dash_billing.chosen(gold).count() == 2
    assert dash_billing.chosen(gold, regions=["r1"], segments=[]).count() == 1
    assert {tuple(r) for r in dash_billing.options(gold).collect()} == {
        ("Region", "r1"), ("Region", "r2"), ("Customer_Segment", "s1"), ("Customer_Segment", "s2"),
    }


def test_sum_of_every_distribution_is_the_row_count(spark):
    gold = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "Payment_Status string")
    assert dash_billing.payment_dist(gold).agg(F.sum("Count")).collect()[0][0] == 3


def test_scratch_tables_go_when_the_block_ends(spark):
    kept = settle(spark.range(3), "kept")
    with scratch(spark):
        path = settle(spark.range(4), "gone").inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))
    assert kept.count() == 3


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert shared_dir(spark) == shared_dir(spark)


def test_broken_records_and_odd_cells_are_counted(spark, tmp_path):
    """A quoted line break survives where allowed, and is counted as broken records where not."""
    folder = tmp_path / "odd"
    folder.mkdir()
    rows = ["Customer_ID,Name,Monthly_Bill", '1,"two\nlines",10.5', "2,plain,inf", '3,comma,"12,5"', "4,short", "5,fine,7.25"]
    (folder / "a.csv").write_text("\n".join(rows) + "\n")
    whole = bronze_csv.read_bronze_csv(spark, str(folder), "customers", multi_line=True)
    stored = layers.write_layer(whole, str(tmp_path), "bronze", "customers")
    assert {r.Customer_ID: r.Monthly_Bill for r in stored.collect()} == {1: 10.5, 2: float("inf"), 3: None, 4: None, 5: 7.25}
    assert stored.where("Customer_ID = 1").first().Name == "two\nlines"
    counts = {r.Column_Name: r.Bad_Values for r in bronze_csv.bad_value_counts(stored).collect()}
    assert counts == {"Monthly_Bill": 1, bronze_csv.RECORD: 1}
    split = layers.write_layer(bronze_csv.read_bronze_csv(spark, str(folder), "customers"), str(tmp_path), "bronze", "split")
    assert {r.Column_Name: r.Bad_Values for r in bronze_csv.bad_value_counts(split).collect()}[bronze_csv.RECORD] >= 2
    found = medallion.run_unreadable({"customers": stored}, str(tmp_path))
    assert {(r.Table_Name, r.Column_Name, r.Bad_Values) for r in found.collect()} == {
        ("customers", "Monthly_Bill", 1), ("customers", bronze_csv.RECORD, 1)
    }
    with pytest.raises(ValueError, match="could not be read"):
        medallion.run_unreadable({"customers": stored}, str(tmp_path), limit=1)


def test_contents_see_a_changed_value(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "i int, s string, x double")
    base = {tuple(r) for r in medallion.contents({"t": df}).collect()}
    assert {r[1:4] for r in base} == {("i", 2, 2), ("s", 2, 1), ("x", 2, 2)}
    assert base == {tuple(r) for r in medallion.contents({"t": df.orderBy("x", ascending=False)}).collect()}
    other = {tuple(r) for r in medallion.contents({"t": df.withColumn("x", F.col("x") + 1)}).collect()}
    assert {r for r in base if r[1] != "x"} == {r for r in other if r[1] != "x"} and base != other


def test_contents_are_sums_of_digests(spark):
    """Values that are looked up count like those that are digested."""
    import hashlib

    whole = [None, -1, 0, 1, 7, 255, 256, 257, 12_345]
    fractions = [None, -0.5, 0.0, -0.0, 0.5, 1.0, 2.25, 4.5, 256.0, 256.5, 1e9, 3.99996, float("nan")]
    data = [(w, w, f, f is None or f > 1, str(w)) for w in whole for f in fractions if f == f] + [(1, 2, 3.0, None, None)]
    df = spark.createDataFrame(data, "i int, l bigint, d double, b boolean, s string").repartition(3)
    bits = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    texts = {"i": str, "l": str, "d": lambda v: str(int((abs(v) * 10_000) + 0.5) * (-1 if v < 0 else 1)), "b": lambda v: str(v).lower(), "s": str}
    expected = []
    for k, (name, text) in enumerate(texts.items()):
        held = [row[k] for row in data if row[k] is not None]
        expected.append(("t", name, len(data), len(held), sum(bits(text(v)) for v in held)))
    assert sorted(map(tuple, medallion.contents({"t": df}).collect())) == sorted(expected)


def test_layer_queries_read_silver_where_it_is_stored(spark, tmp_path, monkeypatch):
    """Gold queries neither copy the silver tables nor settle whole gold tables before they are ordered."""
    from fixtures import registry

    t = registry.Tables(spark, SMALL)
    base = t.silver_base()
    written = []
    monkeypatch.setattr(registry, "write_layer", lambda *a, **k: written.append(a))
    monkeypatch.setattr(medallion, "settle", lambda *a: written.append(a), raising=False)
    found = {name: query(t).collect() for name, query in (("layer_gold", registry._layer_gold), ("gold_chosen", registry._gold_chosen))}
    assert not written and t.silver_base() == base and all(len(rows) == 81 for rows in found.values())


def test_folders_outside_scratch_go_with_the_program(spark):
    from viewmart import session

    path = settle(spark.range(2), "program").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and any(made in path for _, made in session._program)


def test_scratch_blocks_of_threads_are_apart(spark):
    from threading import Thread

    paths = {}

    def job(name, inner):
        with scratch(spark):
            paths[name] = settle(spark.range(3), name).inputFiles()[0].removeprefix("file://")
            inner()

    with scratch(spark):
        kept = settle(spark.range(3), "outer").inputFiles()[0].removeprefix("file://")
        thread = Thread(target=job, args=("thread", lambda: None))
        thread.start()
        thread.join()
        assert os.path.exists(kept) and not os.path.exists(paths["thread"])


def gold_marks(spark, deal):
    t = tables(spark, SMALL)
    tickets, logs = deal(t.tickets, "Ticket_ID"), deal(t.logs, "Log_ID")
    gold = {
        "billing": billing.gold_billing(t.customers, tickets),
        "content": content.gold_content(logs),
        "operations": operations.gold_operations(tickets),
    }
    return sorted(map(tuple, medallion.contents(gold).collect()))


@pytest.fixture(scope="module")
def stored_gold_marks(spark):
    return gold_marks(spark, lambda df, key: df)


@pytest.mark.parametrize("partitions", [1, 3, 8, 50, 200])
def test_gold_does_not_depend_on_the_order_of_rows(spark, stored_gold_marks, partitions):
    """Averages of fractions, and with them scores and checksums, are the same however rows are dealt."""
    dealt = gold_marks(spark, lambda df, key: df.repartition(partitions, F.xxhash64(key, F.lit(partitions))).sortWithinPartitions(F.xxhash64(key)))
    assert dealt == stored_gold_marks


def test_exact_averages_know_no_order(spark):
    values = [0.1 * i for i in range(1000)] + [1e15, -1e15, 1e-7, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    means = {df.repartition(n).agg(exact_avg("x")).first()[0] for n in (1, 3, 17)}
    assert means == {sum(round(1e5 * i) for i in range(1000)) / 1e6 / 1003}
    assert df.where("false").agg(exact_avg("x")).first()[0] is None
