"""Dashboard queries over gold network operations."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.operators import any_of, bin_of, existing, has, histogram, page, value_counts, where_in
from viewmart.plans.dash_billing import filter_options

Choice = Sequence[str] | None


def chosen(gold: DataFrame, equipment: Choice = None, departments: Choice = None) -> DataFrame:
    return where_in(gold, ("Equipment_Model", "Department"), Equipment_Model=equipment, Department=departments)


def options(gold: DataFrame) -> DataFrame:
    return filter_options(gold, "Equipment_Model", "Department")


def kpis(gold: DataFrame) -> DataFrame:
    """The "expert" figure counts the tickets that top-tier technicians handled."""
    return gold.agg(
        F.count("*").alias("Total_Service_Tickets"),
        any_of(gold, "Resolution_Time_Hrs", F.avg, 0.0).alias("Avg_Resolution_Time"),
        any_of(gold, "Performance_Tier", lambda c: F.count_if(c == "Expert"), 0).alias("Expert_Technicians"),
        any_of(gold, "Customer_Satisfaction_Rating", F.avg, 0.0).alias("Avg_Satisfaction_Rating"),
    )


def resolution_hist(gold: DataFrame) -> DataFrame:
    return histogram(gold, "Resolution_Time_Hrs", 20)


def efficiency_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Resolution_Efficiency", "Efficiency")


def tier_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Performance_Tier", "Tier")


def score_hist(gold: DataFrame) -> DataFrame:
    return histogram(gold, "Overall_Performance_Score", 20, 0, 100)


def equipment_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Equipment_Model", "Equipment")


def reliability(gold: DataFrame) -> DataFrame:
    return (
        gold.where(F.col("Equipment_Model").isNotNull())
        .groupBy("Equipment_Model")
        .agg(F.avg("Reliability_Index").alias("Reliability_Index"))
        .orderBy("Reliability_Index", "Equipment_Model")
    )


def issue_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Issue_Category", "Category")


def impact_hist(gold: DataFrame) -> DataFrame:
    return histogram(gold, "Issue_Impact_Score", 15, 0, 100)


def signal_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Signal_Quality", "Quality")


def satisfaction_resolution(gold: DataFrame) -> DataFrame:
    color = "Performance_Tier" if has(gold, "Performance_Tier") else "Status"
    size = existing(gold, ["Issue_Impact_Score"])
    return gold.select("Ticket_ID", "Resolution_Time_Hrs", "Customer_Satisfaction_Rating", *size, color)


def department_summary(gold: DataFrame) -> DataFrame:
    return (
        gold.where(F.col("Department").isNotNull())
        .groupBy("Department")
        .agg(
            F.count("Ticket_ID").alias("Tickets"),
            F.avg("Resolution_Time_Hrs").alias("Avg_Resolution_Hrs"),
            any_of(gold, "Customer_Satisfaction_Rating", F.avg, fv.DEFAULT_RATING).alias("Avg_Satisfaction"),
            any_of(gold, "Overall_Performance_Score", F.avg, float(fv.DEFAULT_PERFORMANCE)).alias("Avg_Performance"),
        )
    )


def department_perf(gold: DataFrame) -> DataFrame:
    """The department measures in long form, one row per bar."""
    measures = ["Avg_Resolution_Hrs", "Avg_Satisfaction", "Avg_Performance"]
    return (
        department_summary(gold)
        .unpivot(["Department", "Tickets"], measures, "Measure", "Value")
        .orderBy("Department", "Measure")
    )


def detail(gold: DataFrame) -> DataFrame:
    return gold.select(existing(gold, fv.OPERATIONS_DETAIL))


def whole_page(gold: DataFrame) -> DataFrame:
    """The KPIs and distributions of the page in one scan, in long form; see ``page``.

    The histogram of hours is not among them: its limits are the column's own, which takes a scan before.
    """
    rows = {"Count": F.count("*")}
    panels = {
        "efficiency": (F.col("Resolution_Efficiency"), rows),
        "tier": (F.col("Performance_Tier"), rows),
        "equipment": (F.col("Equipment_Model"), rows | {"Reliability_Index": F.avg("Reliability_Index")}),
        "issue": (F.col("Issue_Category"), rows),
        "signal": (F.col("Signal_Quality"), rows),
        "score_bins": (bin_of("Overall_Performance_Score", 20, 0, 100), rows),
        "impact_bins": (bin_of("Issue_Impact_Score", 15, 0, 100), rows),
    }
    totals = {
        "Total_Service_Tickets": F.count("*"),
        "Avg_Resolution_Time": F.avg("Resolution_Time_Hrs"),
        "Expert_Technicians": F.count_if(F.col("Performance_Tier") == "Expert"),
        "Avg_Satisfaction_Rating": F.avg("Customer_Satisfaction_Rating"),
    }
    return page(gold, totals, panels)
