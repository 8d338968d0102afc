"""Gold content strategy: one row per genre, channel, device and quality."""

from pyspark.sql import Column, DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.functions import clip, exact, exact_avg, ladder, score
from viewmart.operators import any_of, attach_lookup, most_common, quantile_values, unique_names, with_globals
from viewmart.session import settle


def _part_of_most(measure: str) -> Column:
    return F.try_divide(F.col(measure), F.col(f"_most_{measure}"))


def _log_part_of_most(measure: str) -> Column:
    return F.try_divide(F.log1p(F.col(measure)), F.log1p(F.col(f"_most_{measure}")))


def _with_most(df: DataFrame, source: DataFrame, *measures: str) -> DataFrame:
    return with_globals(df, source, **{f"_most_{name}": F.max(name) for name in measures})


def _without_most(df: DataFrame) -> DataFrame:
    return df.drop(*[name for name in df.columns if name.startswith("_most_")])


# --- aggregates over the logs ------------------------------------------------------------


def _with_viewers(measures: DataFrame, logs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the number of distinct customers per group.

    Pairs of group and customer are made distinct in a shuffle of their own. In one
    aggregation with the measures, every pair would carry all their buffers along.
    """
    pairs = logs.dropna(subset=[*keys, "Customer_ID"]).select(*keys, "Customer_ID").distinct()
    return measures.join(pairs.groupBy(keys).agg(F.count("*").alias(name)), keys, "left").fillna(0)


#: Measures of the logs that a cell averages: column, what stands in where the feed lacks it, result.
_AVERAGED = [
    ("View_Duration_Mins", None, "Average_View_Duration_Mins"),
    ("Buffering_Events", fv.DEFAULT_BUFFERING, "Avg_Buffering_Events"),
    ("User_Rating", fv.DEFAULT_RATING, "Avg_User_Rating"),
]


def viewer_cells(logs: DataFrame) -> DataFrame:
    """Sums and counts per content cell and customer, NULL keys kept.

    Cells, genres, devices and all numbers of distinct viewers add up from it, so gold content
    reads the logs once.
    """
    # Minutes are whole numbers; the others may be fractions.
    added = {name: F.col(name) if name == "View_Duration_Mins" else exact(F.col(name)) for name, _, _ in _AVERAGED if name in logs.columns}
    sums = [
        part for name, value in added.items() for part in (F.sum(value).alias(f"sum_{name}"), F.count(value).alias(f"n_{name}"))
    ]
    return logs.groupBy(*fv.CONTENT_KEYS, "Customer_ID").agg(F.count("Log_ID").alias("views"), *sums)


def cells_of(viewers: DataFrame) -> DataFrame:
    """Views per content cell, from ``viewer_cells``."""
    averages = [
        any_of(viewers, f"n_{name}", lambda n, name=name: F.try_divide(F.sum(f"sum_{name}").cast("double"), F.sum(n)), instead).alias(label)
        for name, instead, label in _AVERAGED
    ]
    return (
        viewers.dropna(subset=fv.CONTENT_KEYS)
        .groupBy(fv.CONTENT_KEYS)
        .agg(
            F.sum("sum_View_Duration_Mins").alias("Total_View_Duration_Mins"),
            averages[0],
            F.sum("views").alias("Total_Views"),
            *averages[1:],
            F.count("Customer_ID").alias("Unique_Customer_Count"),  # a customer has one row in a cell
        )
        .fillna(0)
    )


def content_agg(logs: DataFrame) -> DataFrame:
    """Views per content cell."""
    return cells_of(viewer_cells(logs))


def _by(logs: DataFrame, key: str):
    return logs.where(F.col(key).isNotNull()).groupBy(key)


def genre_viewers(viewers: DataFrame) -> DataFrame:
    """Only what the strength index needs, from ``viewer_cells``; a customer counts once in a genre."""
    by_customer = viewers.where(F.col("Program_Genre").isNotNull()).groupBy("Program_Genre", "Customer_ID").agg(F.sum("views").alias("views"))
    return by_customer.groupBy("Program_Genre").agg(
        F.count("Customer_ID").alias("Genre_Total_Viewers"), F.sum("views").alias("Genre_Total_Views")
    )


def genre_performance(logs: DataFrame) -> DataFrame:
    measures = _by(logs, "Program_Genre").agg(
        F.count("Log_ID").alias("Genre_Total_Views"),
        F.avg("View_Duration_Mins").alias("Genre_Avg_Duration"),
        any_of(logs, "User_Rating", exact_avg, fv.DEFAULT_RATING).alias("Genre_Avg_Rating"),
    )
    counted = _with_viewers(measures, logs, ["Program_Genre"], "Genre_Total_Viewers")
    return _with_quality(counted, logs, "Program_Genre", "Genre_Peak_Quality")


def device_views(viewers: DataFrame) -> DataFrame:
    """From ``viewer_cells``."""
    return _by(viewers, "Device_Type").agg(F.sum("views").alias("Device_Total_Views"))


def device_performance(logs: DataFrame) -> DataFrame:
    measures = _by(logs, "Device_Type").agg(
        F.count("Log_ID").alias("Device_Total_Views"),
        F.avg("View_Duration_Mins").alias("Device_Avg_Duration"),
        any_of(logs, "Buffering_Events", exact_avg, fv.DEFAULT_BUFFERING).alias("Device_Avg_Buffering"),
    )
    counted = _with_viewers(measures, logs, ["Device_Type"], "Device_Unique_Users")
    return _with_quality(counted, logs, "Device_Type", "Device_Preferred_Quality")


def _with_quality(measures: DataFrame, logs: DataFrame, key: str, name: str) -> DataFrame:
    joined = measures.join(most_common(logs, key, "Stream_Quality", name), key, "left")
    return joined.fillna(fv.DEFAULT_QUALITY, subset=[name])


def content_type_performance(logs: DataFrame) -> DataFrame:
    measures = _by(logs, "Content_Type").agg(
        F.count("Log_ID").alias("ContentType_Views"), F.avg("View_Duration_Mins").alias("ContentType_Avg_Duration")
    )
    return _with_viewers(measures, logs, ["Content_Type"], "ContentType_Unique_Viewers")


def logs_with_content_type(logs: DataFrame) -> DataFrame:
    return attach_lookup(logs, settle(content_type_performance(logs), "content-types"), "Content_Type")


def quality_analysis(logs: DataFrame) -> DataFrame:
    return (
        _by(logs, "Stream_Quality")
        .agg(
            F.count("Log_ID").alias("Quality_View_Count"),
            any_of(logs, "Buffering_Events", exact_avg, fv.DEFAULT_BUFFERING).alias("Quality_Avg_Buffering"),
            any_of(logs, "User_Rating", exact_avg, fv.DEFAULT_RATING).alias("Quality_Avg_Rating"),
        )
        .fillna(0)
    )


def viewing_calendar(logs: DataFrame) -> DataFrame:
    start = F.col("Start_Time")
    return logs.withColumns({"Hour_Of_Day": F.hour(start), "Day_Of_Week": F.date_format(start, "EEEE")})


def peak_analysis(logs: DataFrame) -> DataFrame:
    return (
        _by(logs.withColumn("Hour_Of_Day", F.hour("Start_Time")), "Hour_Of_Day")
        .agg(F.count("Log_ID").alias("Peak_Views"), F.avg("View_Duration_Mins").alias("Peak_Duration"))
        .fillna(0)
    )


# --- KPIs per content cell; ``cells`` is a settled content_agg ----------------------------


def engagement_hours() -> Column:
    return F.col("Total_View_Duration_Mins") / 60


def with_cell_ranges(df: DataFrame, cells: DataFrame) -> DataFrame:
    """The largest value any cell has, per measure that a KPI is scaled by."""
    return _with_most(df, cells, "Total_Views", "Average_View_Duration_Mins", "Unique_Customer_Count")


def engagement_score() -> Column:
    return score(
        clip(
            _log_part_of_most("Total_Views") * 40
            + _part_of_most("Average_View_Duration_Mins") * 30
            + F.col("Avg_User_Rating") / 5 * 30
        )
    )


def quality_satisfaction() -> Column:
    buffering = F.col("Avg_Buffering_Events")
    return ladder([(buffering > limit, label) for limit, label in fv.BUFFERING_ABOVE], fv.BUFFERING_OTHER)


def with_popularity(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Quartile of the views; on repeated edges the lowest tier that fits."""
    edges = quantile_values(cells, "Total_Views", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    views = F.col("Total_Views")
    steps = [(views <= F.lit(edge), label) for edge, label in zip(edges.values(), fv.POPULARITY_LABELS)]
    return df.withColumn("Popularity_Tier", F.when(views.isNotNull(), ladder(steps, fv.POPULARITY_LABELS[-1])))


def customer_penetration() -> Column:
    return score(_part_of_most("Unique_Customer_Count") * 100)


def viewing_frequency() -> Column:
    return score(clip(F.try_divide(F.col("Total_Views"), F.col("Unique_Customer_Count")) * 10))


def reach_score() -> Column:
    return score(clip(F.col("Customer_Penetration") * 0.6 + F.col("Viewing_Frequency") * 0.4))


def ad_opportunity_score() -> Column:
    return score(clip(_part_of_most("Total_Views") * 100 - F.col("Avg_User_Rating") / 5 * 20))


def content_health() -> Column:
    engagement = F.col("Engagement_Score")
    return ladder([(engagement >= low, label) for low, label in fv.CONTENT_HEALTH_AT_LEAST], fv.CONTENT_HEALTH_OTHER)


def genre_strength(viewers: DataFrame) -> DataFrame:
    ranged = _with_most(viewers, viewers, "Genre_Total_Viewers")
    index = score(clip(_log_part_of_most("Genre_Total_Viewers") * 100))
    return _without_most(ranged.withColumn("Genre_Strength_Index", index))


def device_adoption(views: DataFrame) -> DataFrame:
    ranged = _with_most(views, views, "Device_Total_Views")
    return _without_most(
        ranged.withColumn("Device_Adoption_Index", score(clip(_part_of_most("Device_Total_Views") * 100)))
    )


def with_genres(df: DataFrame, viewers: DataFrame) -> DataFrame:
    rated = genre_strength(settle(genre_viewers(viewers), "genres"))
    lookup = rated.select("Program_Genre", "Genre_Strength_Index")
    return attach_lookup(df, lookup, "Program_Genre")


def with_devices(df: DataFrame, viewers: DataFrame) -> DataFrame:
    rated = device_adoption(settle(device_views(viewers), "devices"))
    lookup = rated.select("Device_Type", "Device_Adoption_Index")
    return attach_lookup(df, lookup, "Device_Type")


def cell_scores(cells: DataFrame) -> DataFrame:
    """The KPIs that need the content cells alone, but for the popularity tier."""
    df = with_cell_ranges(cells, cells).withColumns(
        {
            "Total_Engagement_Hours": engagement_hours(),
            "Engagement_Score": engagement_score(),
            "Quality_Satisfaction": quality_satisfaction(),
            "Customer_Penetration": customer_penetration(),
            "Viewing_Frequency": viewing_frequency(),
            "Ad_Opportunity_Score": ad_opportunity_score(),
        }
    )
    return df.withColumns({"Content_Health": content_health(), "Content_Reach_Score": reach_score()})


def gold_content(logs: DataFrame) -> DataFrame:
    viewers = settle(viewer_cells(logs), "viewer-cells")
    cells = settle(cells_of(viewers), "content-cells")
    df = with_popularity(cell_scores(cells), cells)
    df = with_devices(with_genres(df, viewers), viewers)
    return df.select(unique_names(fv.GOLD_CONTENT))
