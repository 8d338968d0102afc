"""Formats of dates and numbers that are found from the cells, and pages of one scan."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructType, TimestampNTZType

from viewmart.operators import bin_of, page
from viewmart.plans import medallion
from viewmart.sources.bronze_csv import bad_value_counts, read_bronze_csv
from viewmart.sources.formats import DATE_FORMATS, chosen_formats, read_as, scan_formats

KINDS = StructType().add("day", DateType()).add("at", TimestampNTZType()).add("amount", DoubleType())


def found(spark, rows):
    report = scan_formats(spark.createDataFrame(rows, "day string, at string, amount string"), KINDS)
    return {r.Column_Name: (r.Format, r.Unread, r.Ambiguous) for r in report.where("Chosen").collect()}, report


def test_fewest_unread_cells_decide(spark):
    rows = [("03/25/2024", "25.03.2024 10:15", "1.234,50"), ("3/4/2024", "4.3.2024", "12,5"), ("later", None, "N/A"), (None, "", "7")]
    got, report = found(spark, rows)
    assert got == {"day": ("M/d/yyyy", 1, False), "at": ("d.M.yyyy", 0, False), "amount": ("1.234,5", 0, False)}
    assert chosen_formats(report) == {"day": "M/d/yyyy", "at": "d.M.yyyy", "amount": "1.234,5"}


def test_days_up_to_twelve_are_ambiguous(spark):
    got, report = found(spark, [("03/04/2024", "2024-01-05T10:00:00", "1,234"), ("05/06/2024", None, "2,500")])
    assert got["day"] == ("M/d/yyyy", 0, True) and got["at"] == ("yyyy-M-d", 0, False)
    assert got["amount"] == ("1,234.5", 0, True)
    with pytest.raises(ValueError, match="amount, day"):
        chosen_formats(report)
    assert chosen_formats(report, {"day": "d/M/yyyy", "amount": "1,234.5"})["day"] == "d/M/yyyy"


def test_equal_day_and_month_are_not_ambiguous(spark):
    got, _ = found(spark, [("03/03/2024", None, "5")])
    assert got["day"] == ("M/d/yyyy", 0, False) and got["amount"] == ("1,234.5", 0, False)


def test_empty_and_unreadable_columns(spark):
    got, _ = found(spark, [])
    assert got == {"day": (DATE_FORMATS[0], 0, False), "at": (DATE_FORMATS[0], 0, False), "amount": ("1,234.5", 0, False)}
    got, _ = found(spark, [("soon", "soon", "much")])
    assert got == {"day": (DATE_FORMATS[0], 1, False), "at": (DATE_FORMATS[0], 1, False), "amount": ("1,234.5", 1, False)}
    with pytest.raises(ValueError, match="several ways"):
        scan_formats(spark.createDataFrame([("a",)], "x string"), KINDS)


def test_cells_by_format(spark):
    def value(text, column, way):
        cell = read_as(F.lit(text), KINDS[column].dataType, way).cast("string").alias("v")
        return spark.range(1).select(cell).first().v

    assert value("5 Jan 2024", "day", "d MMM yyyy") == "2024-01-05" and value("Jan 5, 2024", "day", "MMM d, yyyy") == "2024-01-05"
    assert value("20240105", "day", "yyyyMMdd") == "2024-01-05" and value("30.02.2024", "day", "d.M.yyyy") is None
    # 2:30 of that day does not exist in New York; stamps have no zone.
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert value("03/10/2024 02:30:05.5", "at", "M/d/yyyy") == "2024-03-10 02:30:05.5"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert value("-1,234,567.25", "amount", "1,234.5") == "-1234567.25" and value("1,23", "amount", "1,234.5") is None
    assert value("1,5E3", "amount", "1.234,5") == "1500.0" and value("1.5", "amount", "1.234,5") is None


def test_files_are_read_by_the_given_formats(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Customer_ID,Join_Date,Monthly_Bill\n1,25.12.2023,"1.000,5"\n2,soon,"2"\n')
    got = read_bronze_csv(spark, str(tmp_path / "c.csv"), "customers", formats={"Join_Date": "d.M.yyyy", "Monthly_Bill": "1.234,5"})
    rows = got.selectExpr("Customer_ID", "CAST(Join_Date AS STRING)", "Monthly_Bill").orderBy("Customer_ID").collect()
    assert [tuple(r) for r in rows] == [(1, "2023-12-25", 1000.5), (2, None, 2.0)]
    assert [tuple(r) for r in bad_value_counts(got).collect()] == [("Join_Date", 1)]


def test_page_in_one_scan(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", None), (None, 120.0), ("b", -1.0)], "kind string, x double")
    made = page(df, {"Rows": F.count("*")}, {"kind": (F.col("kind"), {"Sum": F.sum("x"), "Rows": F.count("*")}), "bins": (bin_of("x", 4, 0, 100), {"Rows": F.count("*")})})
    assert {tuple(r) for r in made.collect()} == {
        ("total", None, "Rows", 4.0), ("kind", "a", "Sum", 5.0), ("kind", "a", "Rows", 2.0), ("kind", "b", "Sum", -1.0), ("kind", "b", "Rows", 1.0),
        ("bins", "0", "Rows", 2.0), ("bins", "3", "Rows", 1.0),
    }
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 2  # the adaptive plan shows its scan once, the initial plan once more
    assert page(df.where("false"), {"Rows": F.count("*")}, {"kind": (F.col("kind"), {"Rows": F.count("*")})}).collect() == []


def test_unreadable_cells_are_counted_by_the_write(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Customer_ID,Join_Date,Monthly_Bill\n" + "".join(f"{i},{'soon' if i % 4 == 0 else '2024-01-05'},{i}\n" for i in range(40)) + "x,2024-01-05\n")
    bronze = read_bronze_csv(spark, str(tmp_path / "c.csv"), "customers")
    stored, counted = medallion.take_in(spark, {"customers": str(tmp_path / "c.csv")}, str(tmp_path / "lake"))
    want = {("customers", *row) for row in bad_value_counts(bronze).collect()}
    assert {(r.Table_Name, r.Column_Name, r.Bad_Values) for r in counted.collect()} == want == {
        ("customers", "Customer_ID", 1), ("customers", "Join_Date", 10), ("customers", "(record)", 1)
    }
    assert stored["customers"].count() == 41
    assert medallion.run_unreadable(stored, str(tmp_path / "lake"), 12, counted).count() == 3
    with pytest.raises(ValueError, match="12 cells"):
        medallion.run_unreadable(stored, str(tmp_path / "lake"), 11, counted)
    clean = tmp_path / "d.csv"
    clean.write_text("Customer_ID\n1\n")
    assert medallion.take_in(spark, {"customers": str(clean)}, str(tmp_path / "lake"))[1].collect() == []
