"""Log cleaning and content KPIs on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_billing import table
from viewmart import fixed_values as fv
from viewmart.plans import content, dash_content, executive, silver

LOG = dict(
    Log_ID=1, Customer_ID=1, Channel_Name="ch 1", Program_Genre="news", Device_Type="set-top box", Network_Type="w",
    View_Duration_Mins=60, Stream_Quality="hd", Video_Resolution="720p", Buffering_Events=1.0,
    Start_Time=datetime(2026, 3, 13, 23, 59), End_Time=None, Timestamp=None, Content_Type="on-demand",
    Playback_Speed="1x", Subtitles_Enabled=True, Closed_Captions_Enabled=True, DVR_Playback=True, Skip_Ads=True,
    User_Rating=4.0, Autoplay_Triggered=True,
)


def logs(spark, *rows):
    return table(spark, "viewing_logs", LOG, [{"Log_ID": i, **r} for i, r in enumerate(rows)])


def test_silver_logs(spark):
    rows = [
        {"View_Duration_Mins": 9000, "User_Rating": None, "Buffering_Events": None},
        {"View_Duration_Mins": None, "User_Rating": 1.0, "Buffering_Events": 2.0},
        {"User_Rating": 2.0, "Buffering_Events": 4.0},
    ]
    out = {r.Log_ID: r for r in silver.silver_logs(logs(spark, *rows)).collect()}
    assert [out[i].View_Duration_Mins for i in range(3)] == [480, None, 60]
    assert (out[0].User_Rating, out[0].Buffering_Events) == (1.5, 3.0)
    assert (out[0].Device_Type, out[0].Stream_Quality, out[0].Content_Type, out[0].Video_Resolution) == (
        "Set-Top Box", "HD", "On-Demand", "720P",
    )
    assert list(out[0].asDict()) == [name for name, _ in fv.LOG_COLUMNS]


def test_content_agg_drops_incomplete_keys(spark):
    rows = [{}, {"Customer_ID": 2}, {}, {"Customer_ID": None}, {"Stream_Quality": None}, {"Program_Genre": None}]
    out = content.content_agg(logs(spark, *rows)).collect()
    assert len(out) == 1
    assert (out[0].Total_Views, out[0].Unique_Customer_Count, out[0].Total_View_Duration_Mins) == (4, 2, 240)


def test_optional_columns(spark):
    bare = logs(spark, {}, {}).drop("Buffering_Events", "User_Rating")
    row = content.content_agg(bare).collect()[0]
    assert (row.Avg_Buffering_Events, row.Avg_User_Rating) == (0, 4.0)
    assert content.quality_analysis(bare).collect()[0].Quality_Avg_Rating == 4.0
    assert content.device_performance(bare).collect()[0].Device_Avg_Buffering == 0
    assert content.gold_content(bare).columns == fv.GOLD_CONTENT


def test_gold_content(spark):
    rows = [{"Channel_Name": "a", "Customer_ID": i, "User_Rating": 5.0} for i in range(4)]
    rows += [{"Channel_Name": "b", "Customer_ID": 1, "Buffering_Events": 6.0, "View_Duration_Mins": 30}] * 2
    rows += [{"Channel_Name": "c", "Program_Genre": "Drama", "Buffering_Events": 0.0, "User_Rating": 1.0}]
    out = {r.Channel_Name: r for r in content.gold_content(logs(spark, *rows)).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert a.Engagement_Score == 100 and a.Content_Health == "Excellent"
    assert (a.Total_Engagement_Hours, b.Total_Engagement_Hours) == (4.0, 1.0)
    assert [x.Quality_Satisfaction for x in (a, b, c)] == ["Good", "Poor", "Excellent"]
    assert [x.Customer_Penetration for x in (a, b, c)] == [100, 25, 25]
    assert [x.Viewing_Frequency for x in (a, b, c)] == [10, 20, 10]
    assert [x.Content_Reach_Score for x in (a, b, c)] == [64, 23, 19]
    assert [x.Ad_Opportunity_Score for x in (a, b, c)] == [80, 34, 21]
    assert [x.Popularity_Tier for x in (a, b, c)] == ["Viral", "Medium", "Low"]
    assert (a.Genre_Strength_Index, c.Genre_Strength_Index) == (100, 43)
    assert {x.Device_Adoption_Index for x in (a, b, c)} == {100}


def test_popularity_with_repeated_edges(spark):
    cells = spark.createDataFrame([(1,), (1,), (1,), (1,), (9,)], "Total_Views bigint")
    out = content.with_popularity(cells, cells).collect()
    assert sorted(r.Popularity_Tier for r in out) == ["Low"] * 4 + ["Viral"]


def test_peak_quality_ties_and_default(spark):
    rows = [{"Stream_Quality": "HD"}, {"Stream_Quality": "4K"}, {"Program_Genre": "quiet", "Stream_Quality": None}]
    out = {r.Program_Genre: r.Genre_Peak_Quality for r in content.genre_performance(logs(spark, *rows)).collect()}
    assert out == {"news": "4K", "quiet": "HD"}


def test_calendar(spark):
    row = content.viewing_calendar(logs(spark, {})).collect()[0]
    assert (row.Hour_Of_Day, row.Day_Of_Week) == (23, "Friday")
    assert content.peak_analysis(logs(spark, {}, {"Start_Time": None})).collect()[0].Peak_Views == 1


def test_top_rows_break_ties_by_key(spark):
    rows = [("g", f"c{i:02d}", "d", "q", 7, 50, 4.0, 10 if i < 20 else 5) for i in range(30)]
    columns = "Program_Genre string, Channel_Name string, Device_Type string, Stream_Quality string, Total_Views int, Engagement_Score int, Avg_User_Rating double, Content_Reach_Score int"
    gold = spark.createDataFrame(rows, columns).orderBy(F.rand(1))
    assert [r.Channel_Name for r in dash_content.top_viewed(gold).collect()] == [f"c{i:02d}" for i in range(10)]
    assert [r.Channel_Name for r in dash_content.reach_top(gold).collect()] == [f"c{i:02d}" for i in range(15)]
    assert dash_content.top_rated(gold.drop("Channel_Name")).columns[0] == "Program_Genre"


def test_kpis_of_missing_columns_are_zero(spark):
    gold = spark.createDataFrame([(3,), (4,)], "Total_Views bigint")
    assert tuple(dash_content.kpis(gold).collect()[0]) == (7, 0.0, 0.0, 0.0)


def test_detail_is_a_repeatable_shuffle(spark):
    rows = [("g", f"c{i:02d}", "d", "q") for i in range(30)]
    gold = spark.createDataFrame(rows, "Program_Genre string, Channel_Name string, Device_Type string, Stream_Quality string")
    first = [r.Channel_Name for r in dash_content.detail(gold).collect()]
    again = [r.Channel_Name for r in dash_content.detail(gold.repartition(5)).collect()]
    assert first == again != sorted(first) and sorted(first) == [r[1] for r in rows]


def test_risk_counts_missing_status_as_issue(spark):
    gold = spark.createDataFrame([("Paid",), ("Overdue",), (None,)], "Payment_Status string").selectExpr(
        "*", "'High' as Calculated_Churn_Risk", "'Stable' as Contract_Renewal_Risk"
    )
    assert tuple(executive.risk(gold).collect()[0]) == (3, 2, 0)


def test_views_add_up(spark):
    raw = logs(spark, *[{"Channel_Name": f"c{i % 4}", "Customer_ID": i % 3} for i in range(40)])
    gold = content.gold_content(silver.silver_logs(raw))
    assert gold.agg(F.sum("Total_Views")).collect()[0][0] == 40
    scores = ["Engagement_Score", "Customer_Penetration", "Genre_Strength_Index", "Device_Adoption_Index",
              "Viewing_Frequency", "Content_Reach_Score", "Ad_Opportunity_Score"]
    for row in gold.select(scores).collect():
        assert all(0 <= value <= 100 for value in row)


@pytest.mark.parametrize("parts", [1, 16])
def test_gold_content_does_not_depend_on_partitioning(spark, parts):
    rows = [{"Channel_Name": f"c{i % 4}", "Customer_ID": i % 3, "View_Duration_Mins": i} for i in range(60)]
    keys = fv.CONTENT_KEYS
    base = content.gold_content(logs(spark, *rows)).orderBy(keys).collect()
    assert content.gold_content(logs(spark, *rows).repartition(parts)).orderBy(keys).collect() == base
