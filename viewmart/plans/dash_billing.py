"""Dashboard queries over gold billing segmentation."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.operators import bin_of, existing, has, histogram, page, value_counts, where_in

Choice = Sequence[str] | None


def chosen(gold: DataFrame, regions: Choice = None, segments: Choice = None) -> DataFrame:
    return where_in(gold, Region=regions, Customer_Segment=segments)


def options(gold: DataFrame) -> DataFrame:
    """The values each filter offers, over the whole table."""
    return filter_options(gold, "Region", "Customer_Segment")


def filter_options(gold: DataFrame, *names: str) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(name).alias("Filter"), F.col(name).alias("Option")) for name in existing(gold, names)])
    )
    return gold.select(pairs.alias("pair")).select("pair.*").distinct()


def _financial() -> list[Column]:
    revenue = F.sum("Monthly_Bill")
    return [
        revenue.alias("Total_Monthly_Revenue"),
        (revenue * 12).alias("Annual_Revenue"),
        F.count("*").alias("Active_Customers"),
        F.avg("Monthly_Bill").alias("Avg_Monthly_Bill"),
    ]


def _health(gold: DataFrame) -> list[Column]:
    def optional(name: str, measure):
        return measure(F.col(name)) if has(gold, name) else F.lit(0)

    return [
        optional("Service_Health_Score", F.avg).alias("Avg_Health_Score"),
        optional("Payment_Status", lambda c: F.count_if(c == "Paid")).alias("Customers_In_Good_Standing"),
        optional("Calculated_Churn_Risk", lambda c: F.count_if(c == "High")).alias("High_Churn_Risk_Count"),
        optional("Customer_Lifetime_Value", F.avg).alias("Avg_Customer_LTV"),
    ]


def financial_kpis(gold: DataFrame) -> DataFrame:
    return gold.agg(*_financial())


def health_kpis(gold: DataFrame) -> DataFrame:
    return gold.agg(*_health(gold))


def all_kpis(gold: DataFrame) -> DataFrame:
    """Both rows of measures in one scan."""
    return gold.agg(*_financial(), *_health(gold))


def _revenue_by(gold: DataFrame, key: str, name: str, measure: str) -> DataFrame:
    keyed = gold.where(F.col(key).isNotNull())
    return keyed.groupBy(F.col(key).alias(name)).agg(F.sum("Monthly_Bill").alias(measure)).orderBy(name)


def revenue_by_region(gold: DataFrame) -> DataFrame:
    return (
        gold.where(F.col("Region").isNotNull())
        .groupBy("Region")
        .agg(F.sum("Monthly_Bill").alias("Total_Revenue"), F.count("Customer_ID").alias("Customer_Count"))
        .orderBy("Region")
    )


def bill_category_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Bill_Category")


def revenue_by_bill_category(gold: DataFrame) -> DataFrame:
    return _revenue_by(gold, "Bill_Category", "Bill_Category", "Monthly_Bill")


def health_hist(gold: DataFrame) -> DataFrame:
    return histogram(gold, "Service_Health_Score", 20, 0, 100)


def churn_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Calculated_Churn_Risk", "Churn_Risk")


def payment_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Payment_Status")


def contract_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Contract_Renewal_Risk", "Contract_Risk")


def loyalty_ltv(gold: DataFrame) -> DataFrame:
    return gold.select("Customer_ID", "Loyalty_Index", "LTV_Index", "Monthly_Bill", "Service_Health_Score")


def device_hist(gold: DataFrame) -> DataFrame:
    return histogram(gold, "Device_Adoption_Score", 15, 0, 100)


def segment_dist(gold: DataFrame) -> DataFrame:
    return value_counts(gold, "Customer_Segment", "Segment")


def segment_revenue(gold: DataFrame) -> DataFrame:
    return _revenue_by(gold, "Customer_Segment", "Segment", "Revenue")


def detail(gold: DataFrame) -> DataFrame:
    wanted = fv.BILLING_DETAIL if has(gold, "Service_Health_Score") else fv.BILLING_DETAIL_SHORT
    return gold.select(existing(gold, wanted))


def whole_page(gold: DataFrame) -> DataFrame:
    """Every KPI and distribution of the page in one scan, in long form; see ``page``."""
    rows, revenue = {"Count": F.count("*")}, {"Revenue": F.sum("Monthly_Bill")}
    panels = {
        "region": (F.col("Region"), {"Customer_Count": F.count("Customer_ID")} | revenue),
        "bill_category": (F.col("Bill_Category"), rows | revenue),
        "churn": (F.col("Calculated_Churn_Risk"), rows),
        "payment": (F.col("Payment_Status"), rows),
        "contract": (F.col("Contract_Renewal_Risk"), rows),
        "segment": (F.col("Customer_Segment"), rows | revenue),
        "health_bins": (bin_of("Service_Health_Score", 20, 0, 100), rows),
        "device_bins": (bin_of("Device_Adoption_Score", 15, 0, 100), rows),
    }
    names = all_kpis(gold).columns
    return page(gold, dict(zip(names, [*_financial(), *_health(gold)], strict=True)), panels)
