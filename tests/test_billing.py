"""Customer cleaning and KPIs on hand-made rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from viewmart import fixed_values as fv
from viewmart.plans import billing, silver
from viewmart.schemas import bronze_schema
from fixtures import star_schema

AS_OF = date(2026, 3, 13)
BASE = dict(
    Customer_ID=1, Name="ann o'hara", Email="a@x", Phone=None, Address="1 a st, b", City="new york", State="ny",
    Zip_Code="00501", Subscription_Type="family's TOP 120", Service_Tier="VIP", Monthly_Bill=100.0,
    Join_Date=date(2024, 3, 13), Payment_Status="Paid", Region="West", Contract_End=date(2027, 1, 1),
    Age_Group="18-25", Employment_Status="self-employed", Customer_Lifetime_Value=1000.0, Loyalty_Points=100,
    Churn_Risk="Low", Number_Of_Devices=4, Has_Outdoor_Dish=True, Auto_Pay_Enabled=False, Paperless_Billing=True,
    Last_Payment_Date=date(2026, 3, 1),
)
TICKET = dict(
    Ticket_ID=1, Customer_ID=1, Equipment_Model="mini", Issue_Category="billing", Priority_Level="High",
    Signal_Strength_dBm=-60.0, Technician_Assigned="joe", Department="sales", Created_Date=None, Resolved_Date=None,
    Resolution_Time_Hrs=5, Status="open", Customer_Satisfaction_Rating=4.0, Escalation_Flag=True,
    First_Contact_Resolution=True, Technician_Expertise_Level="Junior", Remote_Resolution_Attempted=False,
    On_Site_Visit_Required=False, Cost_Of_Resolution=10.0, Parts_Replaced=False,
)


def table(spark, kind, base, rows):
    schema = bronze_schema(kind)
    return spark.createDataFrame([tuple({**base, **row}[f.name] for f in schema) for row in rows], schema)


def customers(spark, *rows):
    df = table(spark, "customers", BASE, [{k: v for k, v in r.items() if k != "ingest_seq"} for r in rows])
    order = {i: r.get("ingest_seq", i) for i, r in enumerate(rows)}
    seq = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.monotonically_increasing_id().cast("int"))
    return df.coalesce(1).withColumn("ingest_seq", seq)


def tickets(spark, *rows):
    return table(spark, "tickets", TICKET, [{"Ticket_ID": i, **r} for i, r in enumerate(rows)])


def test_silver_cleans_and_keeps_first(spark):
    rows = [
        {"Customer_ID": 1, "Monthly_Bill": None, "ingest_seq": 5},
        {"Customer_ID": 1, "Name": "second", "Monthly_Bill": 300.0, "ingest_seq": 9},
        {"Customer_ID": 2, "Monthly_Bill": 50.0, "Join_Date": date(2027, 6, 1), "Phone": "123"},
        {"Customer_ID": 3, "Monthly_Bill": 70.0, "Join_Date": None},
    ]
    out = {r.Customer_ID: r for r in silver.silver_customers(customers(spark, *rows)).collect()}
    assert len(out) == 3
    assert out[1].Monthly_Bill == 70.0  # median of 300, 50 and 70: taken before repeats are dropped
    assert (out[1].Name, out[1].City, out[1].State) == ("Ann O'Hara", "New York", "NY")
    assert (out[1].Subscription_Type, out[1].Service_Tier) == ("Family'S Top 120", "Vip")
    assert out[1].Employment_Status == "Self-Employed"
    assert (out[1].Phone, out[2].Phone) == ("Unknown", "123")
    assert (out[2].Join_Date, out[3].Join_Date) == (AS_OF, None)
    assert list(out[1].asDict()) == [name for name, _ in fv.CUSTOMER_COLUMNS]


def test_silver_parses_text_dates(spark):
    text = customers(spark, {}).withColumn("Join_Date", F.lit("2025-01-31")).withColumn("Contract_End", F.lit("soon"))
    row = silver.silver_customers(text).collect()[0]
    assert (row.Join_Date, row.Contract_End) == (date(2025, 1, 31), None)


def gold(spark, customer_rows, ticket_rows=()):
    rows = customers(spark, *customer_rows).drop("ingest_seq")
    return {r.Customer_ID: r for r in billing.enrich_customers(rows, tickets(spark, *ticket_rows)).collect()}


def test_customer_without_tickets(spark):
    row = gold(spark, [{}])[1]
    assert (row.Total_Tickets, row.Avg_Satisfaction, row.Avg_Signal_Strength) == (0, 0.0, 0.0)
    assert (row.Service_Health_Score, row.Calculated_Churn_Risk) == (60, "Medium")


def test_ticket_measures_and_health(spark):
    quiet = {"Signal_Strength_dBm": -80.0, "Customer_Satisfaction_Rating": 2.0, "Escalation_Flag": False, "First_Contact_Resolution": False}
    out = gold(spark, [{}, {"Customer_ID": 2}], [{}, quiet, {"Customer_ID": None}] + [{"Customer_ID": 2, "Customer_Satisfaction_Rating": 1.0}] * 10)
    assert (out[1].Total_Tickets, out[1].Critical_Escalations, out[1].FCR_Rate) == (2, 1, 0.5)
    assert (out[1].Avg_Satisfaction, out[1].Avg_Signal_Strength, out[1].Avg_Resolution_Time) == (3.0, -70.0, 5.0)
    assert out[1].Service_Health_Score == 30 + 24 + 24
    # ten tickets and a rating of 1: 30 + 0 + 8
    assert (out[2].Service_Health_Score, out[2].Calculated_Churn_Risk, out[2].Customer_Segment) == (38, "High", "At_Risk_High_Value")


def test_missing_ticket_columns_count_tickets(spark):
    bare = tickets(spark, {}, {}).drop("Escalation_Flag", "Customer_Satisfaction_Rating", "First_Contact_Resolution", "Signal_Strength_dBm")
    row = billing.ticket_metrics(bare).collect()[0]
    assert (row.Critical_Escalations, row.Avg_Satisfaction, row.FCR_Rate, row.Avg_Signal_Strength) == (2, 2, 2, 2)


@pytest.mark.parametrize(
    "bill, category, health",
    [
        (-1.0, None, "Undermonetized"), (0.0, "Low", "Undermonetized"), (79.99, "Low", "Undermonetized"),
        (80.0, "Medium", "Undermonetized"), (100.0, "Medium", "Optimal"), (149.99, "Medium", "Optimal"),
        (150.0, "High", "Optimal"), (180.0, "High", "Premium"),
    ],
)
def test_bill_bands(spark, bill, category, health):
    row = gold(spark, [{"Monthly_Bill": bill}])[1]
    assert (row.Bill_Category, row.Revenue_Health, row.Monthly_Revenue) == (category, health, bill * 12)


@pytest.mark.parametrize("days, label", [(-1, "Expiring Soon"), (29, "Expiring Soon"), (30, "At Risk"), (89, "At Risk"), (90, "Stable")])
def test_renewal_risk(spark, days, label):
    row = gold(spark, [{"Contract_End": AS_OF + timedelta(days=days)}])[1]
    assert (row.Days_Until_Contract_End, row.Contract_Renewal_Risk) == (days, label)


def test_payment_risk(spark):
    rows = [
        {"Customer_ID": 1, "Payment_Status": "Overdue", "Last_Payment_Date": AS_OF - timedelta(days=20)},
        {"Customer_ID": 2, "Payment_Status": "Overdue", "Last_Payment_Date": AS_OF - timedelta(days=80)},
        {"Customer_ID": 3, "Payment_Status": "Pending"}, {"Customer_ID": 4, "Payment_Status": "Disputed"},
        {"Customer_ID": 5}, {"Customer_ID": 6, "Payment_Status": None},
    ]
    out = gold(spark, rows)
    assert [out[i].Payment_Risk_Score for i in range(1, 7)] == [40, 100, 30, 50, 10, 10]


def test_indexes_and_equal_values(spark):
    rows = [{"Customer_ID": i, "Customer_Lifetime_Value": v, "Loyalty_Points": p, "Number_Of_Devices": d}
            for i, (v, p, d) in enumerate([(500.0, 0, 1), (1250.0, 50, 8), (2000.0, 100, 9)])]
    out = gold(spark, rows)
    assert [out[i].LTV_Index for i in range(3)] == [0, 50, 100]
    tenure = 730 / 365.25
    assert [out[i].Loyalty_Index for i in range(3)] == [int(tenure / 5 * 40 + x) for x in (0, 30, 60)]
    assert [out[i].Device_Adoption_Score for i in range(3)] == [12, 100, 100]
    same = gold(spark, [{"Customer_ID": 1, "Loyalty_Points": 0}, {"Customer_ID": 2, "Loyalty_Points": 0}])
    # nothing to scale by: the score is not defined and shows as 0
    assert {(r.LTV_Index, r.Loyalty_Index) for r in same.values()} == {(0, 0)}


def test_segments(spark):
    happy = [{"Customer_ID": 2, "Customer_Satisfaction_Rating": 5.0}]
    rows = [{"Customer_ID": 1, "Customer_Lifetime_Value": 9000.0}, {"Customer_ID": 2}, {"Customer_ID": 3}]
    out = gold(spark, rows, happy)
    assert [out[i].Customer_Segment for i in (1, 2, 3)] == ["Growth_Opportunity", "VIP_Advocates", "Standard"]


def test_gold_columns_and_empty_input(spark):
    empty = customers(spark, {}).drop("ingest_seq").where("false")
    df = billing.gold_billing(empty, tickets(spark, {}))
    assert df.columns == fv.GOLD_BILLING and len(df.columns) == 38
    assert df.collect() == []


@pytest.mark.parametrize("parts", [1, 64])
def test_gold_does_not_depend_on_partitioning(spark, parts):
    folder = "/root/testdata/sf0.001"
    def build(n):
        clean = silver.silver_customers(star_schema.customers(spark, folder).repartition(n))
        work = silver.silver_tickets(star_schema.tickets(spark, folder).repartition(n))
        return {r.Customer_ID: r for r in billing.gold_billing(clean, work).collect()}
    base, other = build(3), build(parts)
    assert base.keys() == other.keys()
    for key, row in base.items():
        for name, value in row.asDict().items():
            assert other[key][name] == (pytest.approx(value) if isinstance(value, float) else value)
