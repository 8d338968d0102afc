"""Dashboard queries over gold content strategy."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.operators import any_of, bin_of, existing, has, histogram, page, value_counts, where_in
from viewmart.plans.dash_billing import filter_options

Choice = Sequence[str] | None


def chosen(gold: DataFrame, genres: Choice = None, devices: Choice = None) -> DataFrame:
    return where_in(gold, Program_Genre=genres, Device_Type=devices)


def options(gold: DataFrame) -> DataFrame:
    return filter_options(gold, "Program_Genre", "Device_Type")


def _label(gold: DataFrame) -> str:
    return "Channel_Name" if has(gold, "Channel_Name") else "Program_Genre"


def kpis(gold: DataFrame) -> DataFrame:
    return gold.agg(
        any_of(gold, "Total_Views", F.sum, 0).alias("Total_Views"),
        any_of(gold, "Total_Engagement_Hours", F.sum, 0.0).alias("Total_Engagement_Hours"),
        any_of(gold, "Unique_Customer_Count", F.avg, 0.0).alias("Avg_Unique_Viewers"),
        any_of(gold, "Avg_User_Rating", F.avg, 0.0).alias("Avg_User_Rating"),
    )


def genre_duration(gold: DataFrame) -> DataFrame:
    return (
        gold.where(F.col("Program_Genre").isNotNull())
        .groupBy("Program_Genre")
        .agg(
            F.sum("Total_View_Duration_Mins").alias("Total_View_Duration_Mins"),
            F.sum("Total_Views").alias("Total_Views"),
        )
        .orderBy("Total_View_Duration_Mins", "Program_Genre")
    )


def device_views(gold: DataFrame) -> DataFrame:
    """Views and summed viewers per device; a viewer counts once per content cell."""
    return (
        gold.where(F.col("Device_Type").isNotNull())
        .groupBy("Device_Type")
        .agg(F.sum("Total_Views").alias("Total_Views"), F.sum("Unique_Customer_Count").alias("Unique_Customer_Count"))
        .orderBy("Device_Type")
    )


def engagement_hist(gold: DataFrame) -> DataFrame:
    return histogram(gold, "Engagement_Score", 15, 0, 100)


def quality_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Quality_Satisfaction", "Quality")


def popularity_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Popularity_Tier", "Tier")


def health_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Content_Health", "Health")


def _top(gold: DataFrame, measure: str, rows: int) -> DataFrame:
    """The rows with the largest measure; ties go to the first in key order."""
    return gold.orderBy(F.desc_nulls_last(measure), *existing(gold, fv.CONTENT_KEYS)).limit(rows)


def reach_top(gold: DataFrame, rows: int = 15) -> DataFrame:
    label = _label(gold)
    return (
        _top(gold, "Content_Reach_Score", rows)
        .groupBy(label)
        .agg(F.avg("Content_Reach_Score").alias("Content_Reach_Score"))
        .orderBy("Content_Reach_Score", label)
    )


def engagement_rating(gold: DataFrame) -> DataFrame:
    return gold.select(
        "Program_Genre", "Channel_Name", "Engagement_Score", "Avg_User_Rating", "Total_Views", "Content_Health"
    )


def top_viewed(gold: DataFrame, rows: int = 10) -> DataFrame:
    return _top(gold, "Total_Views", rows).select(_label(gold), "Total_Views", "Engagement_Score", "Avg_User_Rating")


def top_rated(gold: DataFrame, rows: int = 10) -> DataFrame:
    return _top(gold, "Avg_User_Rating", rows).select(
        _label(gold), "Avg_User_Rating", "Engagement_Score", "Total_Views"
    )


def detail(gold: DataFrame, seed: int = fv.SHUFFLE_SEED) -> DataFrame:
    """All rows in a repeatable mixed order."""
    mixed = gold.orderBy(F.xxhash64(*existing(gold, fv.CONTENT_KEYS), F.lit(seed)))
    return mixed.select(existing(gold, fv.CONTENT_DETAIL))


def whole_page(gold: DataFrame) -> DataFrame:
    """The KPIs and distributions of the page in one scan, in long form; see ``page``."""
    rows, views = {"Count": F.count("*")}, {"Total_Views": F.sum("Total_Views")}
    panels = {
        "genre": (F.col("Program_Genre"), views | {"Total_View_Duration_Mins": F.sum("Total_View_Duration_Mins")}),
        "device": (F.col("Device_Type"), views | {"Unique_Customer_Count": F.sum("Unique_Customer_Count")}),
        "quality": (F.col("Quality_Satisfaction"), rows),
        "popularity": (F.col("Popularity_Tier"), rows),
        "health": (F.col("Content_Health"), rows),
        "engagement_bins": (bin_of("Engagement_Score", 15, 0, 100), rows),
    }
    totals = views | {
        "Total_Engagement_Hours": F.sum("Total_Engagement_Hours"),
        "Avg_Unique_Viewers": F.avg("Unique_Customer_Count"),
        "Avg_User_Rating": F.avg("Avg_User_Rating"),
    }
    return page(gold, totals, panels)
