"""Ticket cleaning and KPIs on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_billing import tickets
from viewmart import fixed_values as fv
from viewmart.plans import dash_operations, operations, silver
from viewmart.session import settle

START = datetime(2026, 1, 10, 12)


def by_id(df, key="Ticket_ID"):
    return {r[key]: r for r in df.collect()}


def test_silver_tickets(spark):
    rows = [
        {"Signal_Strength_dBm": None, "Technician_Assigned": None, "Customer_Satisfaction_Rating": None, "Status": "CLOSED"},
        {"Signal_Strength_dBm": -40.0, "Customer_Satisfaction_Rating": 1.0, "Status": "Clsd"},
        {"Signal_Strength_dBm": -50.0, "Customer_Satisfaction_Rating": 4.0},
        {"Equipment_Model": "4K mini", "Customer_Satisfaction_Rating": 2.0, "Signal_Strength_dBm": -60.0},
    ]
    out = by_id(silver.silver_tickets(tickets(spark, *rows)))
    assert (out[0].Signal_Strength_dBm, out[0].Customer_Satisfaction_Rating) == (-50.0, 2.0)
    assert (out[0].Technician_Assigned, out[1].Technician_Assigned) == ("Unassigned", "Joe")
    assert [out[i].Status for i in range(3)] == ["Closed", "Clsd", "Open"]
    assert out[3].Equipment_Model == "4K Mini"
    assert list(out[0].asDict()) == [name for name, _ in fv.TICKET_COLUMNS]


def test_silver_imputes_buffering_when_present(spark):
    df = tickets(spark, {}, {}).withColumn("Buffering_Events", F.when(F.col("Ticket_ID") == 0, 3.0))
    assert [r.Buffering_Events for r in silver.silver_tickets(df).collect()] == [3.0, 3.0]


def test_technician_scores_use_truncated_parts(spark):
    rows = [
        {"Technician_Assigned": "a", "Resolution_Time_Hrs": 1, "Customer_Satisfaction_Rating": 5.0, "Cost_Of_Resolution": 1.0},
        {"Technician_Assigned": "b", "Resolution_Time_Hrs": 30, "Customer_Satisfaction_Rating": 3.3, "Cost_Of_Resolution": 90.0},
        {"Technician_Assigned": "b", "Resolution_Time_Hrs": 31, "First_Contact_Resolution": False, "Cost_Of_Resolution": 90.0},
    ]
    stats = settle(operations.technician_stats(tickets(spark, *rows)), "t")
    out = by_id(operations.technician_scores(stats), "Technician_Assigned")
    assert (out["a"].Speed_Score, out["a"].Satisfaction_Score, out["a"].FCR_Score, out["a"].Cost_Efficiency_Score) == (96, 100, 100, 98)
    assert (out["a"].Overall_Performance_Score, out["a"].Performance_Tier) == (int(96 * 0.25 + 35 + 25 + 98 * 0.15), "Expert")
    assert (out["b"].Speed_Score, out["b"].Satisfaction_Score, out["b"].FCR_Score, out["b"].Cost_Efficiency_Score) == (0, 73, 50, 0)
    assert out["b"].Performance_Tier == "Developing" and out["b"].Tickets_Count == 2


def test_single_technician_is_slowest(spark):
    stats = settle(operations.technician_stats(tickets(spark, {"Cost_Of_Resolution": 0.0})), "t")
    row = operations.technician_scores(stats).collect()[0]
    assert (row.Speed_Score, row.Cost_Efficiency_Score) == (0, 0)  # nothing to divide by scores 0


@pytest.mark.parametrize("hours, label", [(0, None), (4, "Critical_4h"), (5, "High_24h"), (24, "High_24h"), (72, "Medium_72h"), (73, "Low_Extended")])
def test_resolution_band(spark, hours, label):
    df = tickets(spark, {"Resolution_Time_Hrs": hours})
    assert df.select(operations.resolution_band().alias("b")).collect()[0].b == label


@pytest.mark.parametrize("signal, label", [(-50.0, "Excellent"), (-70.0, "Good"), (-85.0, "Fair"), (-86.0, "Poor"), (None, "Poor")])
def test_signal_quality(spark, signal, label):
    df = tickets(spark, {"Signal_Strength_dBm": signal})
    assert df.select(operations.signal_quality().alias("q")).collect()[0].q == label


def test_sla(spark):
    def took(priority, hours):
        return {"Priority_Level": priority, "Created_Date": START, "Resolved_Date": START + timedelta(hours=hours)}
    rows = [took("Critical", 4), took("Critical", 4.5), took("High", 8), took("Low", -12), took(None, 72), took("Odd", 73),
            {"Priority_Level": "Medium", "Created_Date": START}]
    out = by_id(operations.with_sla(tickets(spark, *rows)))
    assert [out[i].SLA_Met for i in range(7)] == [True, False, True, True, True, False, False]
    assert [out[i].Days_To_Resolve for i in range(7)] == [0, 0, 0, -1, 3, 3, None]
    assert [out[i].Priority_Response_SLA for i in range(7)] == ["<4h", "<4h", "<8h", "<72h", "<72h", "<72h", "<24h"]
    bare = operations.with_sla(tickets(spark, {}).drop("Priority_Level", "Resolved_Date"))
    assert bare.collect()[0].Priority_Response_SLA == "<24h" and "SLA_Met" not in bare.columns


def test_equipment_and_departments(spark):
    rows = [{"Equipment_Model": "a", "Escalation_Flag": False}] * 4 + [{"Equipment_Model": "b"}, {"Equipment_Model": None, "Department": None}]
    work = tickets(spark, *rows)
    rated = by_id(operations.equipment_reliability(settle(operations.equipment_stats(work), "e")), "Equipment_Model")
    assert {k: v.Reliability_Index for k, v in rated.items()} == {"a": 60, "b": 30}
    assert rated["a"].High_Priority_Rate == 1.0
    joined = by_id(operations.with_equipment(work, operations.work_cells(work)))
    assert joined[5].Reliability_Index is None and joined[0].Reliability_Index == 60
    assert by_id(operations.with_departments(work, work))[5].Dept_Efficiency is None


def test_impact_score(spark):
    work = tickets(spark, {"Status": "Closed"}, {"Customer_Satisfaction_Rating": 2.0}, {"Customer_ID": None, "Escalation_Flag": None})
    assert operations.impact_score(work)._jc.toString() == "50"
    joined = operations.tickets_with_customer_metrics(work)
    out = by_id(joined.select("Ticket_ID", operations.impact_score(joined).alias("s")))
    assert [out[i].s for i in range(3)] == [0 + 25 + 2 + 40, 25 + 25 + 2 + 40, 25 + 0 + 0 + 0]


def test_gold_operations_keeps_every_ticket(spark):
    work = tickets(spark, {"Resolution_Time_Hrs": 1}, {"Resolution_Time_Hrs": 9}, {"Resolution_Time_Hrs": None})
    df = operations.gold_operations(work)
    assert df.columns == [name for name, _ in fv.GOLD_OPERATIONS]
    out = by_id(df)
    assert [out[i].Resolution_Efficiency for i in range(3)] == ["High", "Low", "Low"]
    assert {r.Issue_Impact_Score for r in out.values()} == {50}


def test_gold_operations_with_missing_columns(spark):
    bare = tickets(spark, {}).drop("Priority_Level", "Department", "Created_Date", "Cost_Of_Resolution", "Escalation_Flag")
    df = operations.gold_operations(bare)
    gone = {"Priority_Level", "Department", "Created_Date", "Cost_Of_Resolution", "Escalation_Flag"}
    assert df.columns == [name for name, _ in fv.GOLD_OPERATIONS if name not in gone]
    assert df.count() == 1


def test_department_view_defaults(spark):
    bare = operations.gold_operations(tickets(spark, {})).drop("Customer_Satisfaction_Rating", "Overall_Performance_Score")
    row = dash_operations.department_summary(bare).collect()[0]
    assert (row.Avg_Satisfaction, row.Avg_Performance) == (4.0, 75.0)
