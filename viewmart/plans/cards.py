"""KPI cards: one row per card with its title and its text."""

from pyspark.sql import Column, DataFrame, functions as F

from viewmart.functions.display import money_text, number_text, plain_text, rating_text
from viewmart.plans import dash_billing, dash_content, dash_operations, executive


def _cards(row: DataFrame, cards: dict[str, Column]) -> DataFrame:
    """Unfold a one-row table of measures."""
    return row.select([text.alias(title) for title, text in cards.items()]).unpivot([], list(cards), "Card", "Text")


def billing(gold: DataFrame) -> DataFrame:
    return _cards(
        dash_billing.all_kpis(gold),
        {
            "Total Monthly Revenue": money_text(F.col("Total_Monthly_Revenue")),
            "Annual Revenue (Projected)": money_text(F.col("Annual_Revenue")),
            "Active Customers": number_text(F.col("Active_Customers")),
            "Avg Monthly Bill": money_text(F.col("Avg_Monthly_Bill"), 2),
            "Avg Health Score (0-100)": plain_text(F.col("Avg_Health_Score"), 1),
            "Customers in Good Standing": number_text(F.col("Customers_In_Good_Standing")),
            "High Churn Risk Count": number_text(F.col("High_Churn_Risk_Count")),
            "Avg Customer LTV": money_text(F.col("Avg_Customer_LTV")),
        },
    )


def content(gold: DataFrame) -> DataFrame:
    return _cards(
        dash_content.kpis(gold),
        {
            "Total Views": number_text(F.col("Total_Views")),
            "Total Engagement Hours": number_text(F.col("Total_Engagement_Hours")),
            "Avg Unique Viewers": number_text(F.col("Avg_Unique_Viewers")),
            "Avg User Rating": rating_text(F.col("Avg_User_Rating")),
        },
    )


def operations(gold: DataFrame) -> DataFrame:
    return _cards(
        dash_operations.kpis(gold),
        {
            "Total Service Tickets": number_text(F.col("Total_Service_Tickets")),
            "Avg Resolution Time (hrs)": plain_text(F.col("Avg_Resolution_Time"), 1),
            "Expert Technicians": number_text(F.col("Expert_Technicians")),
            "Avg Satisfaction Rating": rating_text(F.col("Avg_Satisfaction_Rating")),
        },
    )


def overview(billing_gold: DataFrame, operations_gold: DataFrame, content_gold: DataFrame) -> DataFrame:
    return _cards(
        executive.overview(billing_gold, operations_gold, content_gold),
        {
            "Total Customers": number_text(F.col("Total_Customers")),
            "Monthly Revenue": money_text(F.col("Monthly_Revenue")),
            "Avg Customer Satisfaction": rating_text(F.col("Avg_Customer_Satisfaction")),
            "Total Content Views": number_text(F.col("Total_Content_Views")),
        },
    )
