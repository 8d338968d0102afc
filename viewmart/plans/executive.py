"""Executive summary over the three gold tables, and the layer reconciliation."""

from pyspark.sql import DataFrame, functions as F

# One-row aggregates are joined below, so every cross join is one row by one row.


def overview(billing: DataFrame, operations: DataFrame, content: DataFrame) -> DataFrame:
    customers = billing.agg(F.count("*").alias("Total_Customers"), F.sum("Monthly_Bill").alias("Monthly_Revenue"))
    rating = operations.agg(F.avg("Customer_Satisfaction_Rating").alias("Avg_Customer_Satisfaction"))
    views = content.agg(F.sum("Total_Views").alias("Total_Content_Views"))
    return customers.crossJoin(rating).crossJoin(views)


def revenue_health(billing: DataFrame) -> DataFrame:
    revenue = F.sum("Monthly_Bill")
    return billing.agg(
        revenue.alias("Total_Monthly_Revenue"),
        F.count_if(F.col("Bill_Category") == "High").alias("High_Value_Customers"),
        (revenue * 12).alias("Annual_Revenue_Projection"),
    )


def risk(billing: DataFrame) -> DataFrame:
    """A customer without a payment status counts as a payment issue."""
    return billing.agg(
        F.count_if(F.col("Calculated_Churn_Risk") == "High").alias("High_Churn_Risk"),
        F.count_if(~F.col("Payment_Status").eqNullSafe("Paid")).alias("Payment_Issues"),
        F.count_if(F.col("Contract_Renewal_Risk") == "Expiring Soon").alias("Contracts_Expiring_Soon"),
    )


def performance(operations: DataFrame, content: DataFrame) -> DataFrame:
    work = operations.agg(
        F.count_if(F.col("Performance_Tier") == "Expert").alias("Expert_Technicians"),
        F.avg("Resolution_Time_Hrs").alias("Avg_Resolution_Time"),
    )
    return work.crossJoin(content.agg(F.count_if(F.col("Popularity_Tier") == "Viral").alias("Viral_Content")))


def revenue_at_risk(billing: DataFrame) -> DataFrame:
    return (
        billing.where(F.col("Calculated_Churn_Risk").isNotNull())
        .groupBy("Calculated_Churn_Risk")
        .agg(F.sum("Monthly_Bill").alias("Monthly_Bill"))
        .orderBy("Calculated_Churn_Risk")
    )


def engagement_vs_rating(content: DataFrame) -> DataFrame:
    means = content.agg(
        F.avg("Engagement_Score").alias("Engagement Score"), (F.avg("Avg_User_Rating") * 20).alias("User Rating")
    )
    return means.unpivot([], ["Engagement Score", "User Rating"], "Metric", "Score")


def layer_reconciliation(bronze_logs: DataFrame, gold_content: DataFrame) -> DataFrame:
    """Rows, distinct genres and rows per genre of both layers, in long form.

    Everything follows from the rows per genre, so each layer is read and shuffled once.
    """
    parts = []
    for layer, df in (("bronze", bronze_logs), ("gold", gold_content)):
        genres = df.groupBy("Program_Genre").agg(F.count("*").alias("Count"))
        totals = genres.agg(
            F.coalesce(F.sum("Count"), F.lit(0)).alias("rows"), F.count("Program_Genre").alias("genres")
        ).unpivot([], ["rows", "genres"], "Item", "Count")
        named = genres.where(F.col("Program_Genre").isNotNull()).select(
            F.concat(F.lit("genre "), "Program_Genre").alias("Item"), "Count"
        )
        parts += [part.select(F.lit(layer).alias("Layer"), "Item", "Count") for part in (totals, named)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
