"""Column builders on hand-made values."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from viewmart.fixed_values import BILL_BANDS, RESOLUTION_BANDS
from viewmart.functions import (
    bands, clip, days_until, elapsed_days, elapsed_hours, ladder, null_tokens_to_null, score, title_case, truncate,
)
from viewmart.functions.display import money_text, number_text, rating_text


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row.r for row in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def test_title_case_restarts_words_after_any_non_letter(spark):
    texts = [
        "family's top 120", "4K MINI", "set-top box", "o'neil-smith jr.", "", " two  spaces ", "a1b2c3", "ÉCOLE élan",
        "x_y.z", "tab\tand\nline", "straßenbahn", "中abc ДОМ дом", "123", None,
    ]
    assert column(spark, texts, "string", title_case) == [t if t is None else t.title() for t in texts]


def test_title_case_matches_python_on_random_text(spark):
    rng = random.Random(11)
    letters = "abcxyzABCXYZéÉñÑøØ 0123456789'-_./&\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(500)]
    assert column(spark, texts, "string", title_case) == [t.title() for t in texts]


def test_null_tokens(spark):
    texts = ["NA", "None", "nan", "", "N/A", "null", "Nancy", "none", " ", None]
    assert column(spark, texts, "string", null_tokens_to_null) == [None] * 6 + ["Nancy", "none", " ", None]


def test_clip_keeps_null(spark):
    assert column(spark, [-1.0, 0.0, 50.5, 100.0, 1e9, None], "double", clip) == [0.0, 0.0, 50.5, 100.0, 100.0, None]


def test_truncate_goes_toward_zero_and_score_defaults(spark):
    values = [69.9999, -0.5, -1.7, None]
    assert column(spark, values, "double", truncate) == [69, 0, -1, None]
    assert column(spark, values, "double", score) == [69, 0, -1, 0]


def test_ladder_falls_through_on_null(spark):
    build = lambda c: ladder([(c < 40, "High"), (c < 70, "Medium")], "Low")
    assert column(spark, [39, 40, 69, 70, None], "int", build) == ["High", "Medium", "Medium", "Low", "Low"]


@pytest.mark.parametrize(
    "edges, closed, values, expected",
    [
        (BILL_BANDS, "left", [-1.0, 0.0, 79.99, 80.0, 149.99, 150.0, None], [None, "Low", "Low", "Medium", "Medium", "High", None]),
        (
            RESOLUTION_BANDS, "right", [0.0, 4.0, 4.1, 24.0, 72.0, 73.0, None],
            [None, "Critical_4h", "High_24h", "High_24h", "Medium_72h", "Low_Extended", None],
        ),
    ],
)
def test_bands(spark, edges, closed, values, expected):
    assert column(spark, values, "double", lambda c: bands(c, edges, closed)) == expected


def test_elapsed_time_is_zone_free_and_floors_days(spark):
    noon = datetime(2026, 3, 29, 12)
    pairs = [
        (noon, datetime(2026, 3, 29, 0)), (noon, datetime(2026, 3, 30, 11, 59, 59)), (noon, datetime(2026, 4, 1, 12)),
        (datetime(2026, 3, 29, 1), datetime(2026, 3, 29, 4, 0, 0, 500000)), (noon, None),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a timestamp_ntz, b timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = df.select(
                "i", elapsed_hours(F.col("a"), F.col("b")).alias("h"), elapsed_days(F.col("a"), F.col("b")).alias("d")
            ).orderBy("i").collect()
            assert [r.d for r in rows] == [-1, 0, 3, 0, None]
            assert [r.h for r in rows[:1] + rows[2:4]] == [-12.0, 72.0, pytest.approx(3 + 0.5 / 3600)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_days_until(spark):
    days = [date(2026, 3, 12), date(2026, 4, 12), None]
    assert column(spark, days, "date", lambda c: days_until(c, date(2026, 3, 13))) == [-1, 30, None]


def test_display_texts(spark):
    assert column(spark, [1234567.4, None], "double", money_text) == ["$1,234,567", None]
    assert column(spark, [9876], "bigint", number_text) == ["9,876"]
    assert column(spark, [3.456], "double", rating_text) == ["3.46/5.0"]
