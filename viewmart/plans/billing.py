"""Gold billing segmentation: one row per customer."""

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.functions import bands, clip, days_until, exact_avg, ladder, score
from viewmart.operators import has, with_globals


def ticket_metrics(tickets: DataFrame) -> DataFrame:
    """Per-customer ticket measures; a missing input column counts tickets instead."""
    number = F.count("Ticket_ID")

    def measure(name: str, build) -> Column:
        return build(F.col(name)) if has(tickets, name) else number

    return (
        tickets.where(F.col("Customer_ID").isNotNull())
        .groupBy("Customer_ID")
        .agg(
            number.alias("Total_Tickets"),
            F.avg("Resolution_Time_Hrs").alias("Avg_Resolution_Time"),
            measure("Escalation_Flag", lambda c: F.sum(c.cast("int"))).alias("Critical_Escalations"),
            measure("Customer_Satisfaction_Rating", exact_avg).alias("Avg_Satisfaction"),
            measure("First_Contact_Resolution", lambda c: F.avg(c.cast("int"))).alias("FCR_Rate"),
            measure("Signal_Strength_dBm", exact_avg).alias("Avg_Signal_Strength"),
        )
        .fillna(0)
    )


def customers_with_tickets(customers: DataFrame, tickets: DataFrame) -> DataFrame:
    """Customers with their ticket measures; numeric gaps become 0.

    Both sides have one row per customer by now, so the shuffle by id is even.
    """
    return customers.join(ticket_metrics(tickets), "Customer_ID", "left").fillna(0)


def tenure_years(as_of: date) -> Column:
    return -days_until(F.col("Join_Date"), as_of) / F.lit(365.25)


def bill_category() -> Column:
    return bands(F.col("Monthly_Bill"), fv.BILL_BANDS, closed="left")


def monthly_revenue() -> Column:
    """Twelve monthly bills; the column keeps its established name."""
    return F.col("Monthly_Bill") * 12


def service_health_score() -> Column:
    weight = fv.HEALTH_WEIGHTS
    return score(
        clip(100 - F.col("Avg_Signal_Strength")) * weight["signal"]
        + clip(100 - F.col("Total_Tickets") * 10) * weight["volume"]
        + clip(F.col("Avg_Satisfaction") * 20) * weight["satisfaction"]
    )


def payment_days(as_of: date) -> Column:
    return -days_until(F.col("Last_Payment_Date"), as_of)


def payment_risk_score() -> Column:
    status = F.col("Payment_Status")
    fixed = [(status == name, F.lit(risk)) for name, risk in fv.PAYMENT_RISK.items()]
    overdue = (status == "Overdue", clip(F.col("Payment_Days_Overdue") * 2))
    return score(ladder([overdue, *fixed], F.lit(fv.PAYMENT_RISK_OTHER)))


def _below(column: str, steps: list[tuple[float, str]], otherwise: str) -> Column:
    return ladder([(F.col(column) < limit, label) for limit, label in steps], otherwise)


def churn_risk() -> Column:
    return _below("Service_Health_Score", fv.CHURN_BELOW, fv.CHURN_OTHER)


def contract_days(as_of: date) -> Column:
    return days_until(F.col("Contract_End"), as_of)


def renewal_risk() -> Column:
    return _below("Days_Until_Contract_End", fv.RENEWAL_BELOW, fv.RENEWAL_OTHER)


def revenue_health() -> Column:
    return _below("Monthly_Bill", fv.REVENUE_HEALTH_BELOW, fv.REVENUE_HEALTH_OTHER)


def customer_segment() -> Column:
    health, value = F.col("Service_Health_Score"), F.col("LTV_Index")
    return ladder(
        [
            (health >= 80, "VIP_Advocates"),
            ((health >= 60) & (value >= 50), "Growth_Opportunity"),
            (health < 40, "At_Risk_High_Value"),
        ],
        "Standard",
    )


def device_adoption_score() -> Column:
    return score(clip(F.col("Number_Of_Devices") / 8 * 100))


def with_customer_ranges(df: DataFrame, customers: DataFrame) -> DataFrame:
    """The smallest and largest lifetime value and the most loyalty points of all customers."""
    value = F.coalesce("Customer_Lifetime_Value", F.lit(0.0))
    points = F.coalesce("Loyalty_Points", F.lit(0))
    return with_globals(
        df, customers, _least_value=F.min(value), _most_value=F.max(value), _most_points=F.max(points)
    )


def ltv_index() -> Column:
    """Lifetime value on a 0-100 scale between the smallest and the largest."""
    above = F.col("Customer_Lifetime_Value") - F.col("_least_value")
    return score(clip(F.try_divide(above, F.col("_most_value") - F.col("_least_value")) * 100))


def loyalty_index() -> Column:
    """Tenure against five years, plus points against the most points anyone has."""
    share = clip(F.try_divide(F.col("Loyalty_Points"), F.col("_most_points")) * 60, 0, 60)
    return score(clip(F.col("Customer_Tenure_Years") / 5 * 40 + share))


def enrich_customers(customers: DataFrame, tickets: DataFrame, as_of: date = fv.AS_OF) -> DataFrame:
    """Every customer KPI, before the final choice of columns."""
    df = customers_with_tickets(customers, tickets).withColumns(
        {
            "Customer_Tenure_Years": tenure_years(as_of),
            "Bill_Category": bill_category(),
            "Monthly_Revenue": monthly_revenue(),
            "Service_Health_Score": service_health_score(),
            "Payment_Days_Overdue": payment_days(as_of),
            "Device_Adoption_Score": device_adoption_score(),
            "Days_Until_Contract_End": contract_days(as_of) if has(customers, "Contract_End") else F.lit(0),
            "Revenue_Health": revenue_health(),
        }
    )
    df = with_customer_ranges(df, customers).withColumns(
        {"LTV_Index": ltv_index(), "Loyalty_Index": loyalty_index()}
    )
    return df.withColumns(
        {
            "Payment_Risk_Score": payment_risk_score(),
            "Calculated_Churn_Risk": churn_risk(),
            "Contract_Renewal_Risk": renewal_risk(),
            "Customer_Segment": customer_segment(),
        }
    )


def gold_billing(customers: DataFrame, tickets: DataFrame, as_of: date = fv.AS_OF) -> DataFrame:
    return enrich_customers(customers, tickets, as_of).select(fv.GOLD_BILLING)
