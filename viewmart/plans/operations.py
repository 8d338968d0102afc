"""Gold network operations: one row per ticket."""

from pyspark.sql import Column, DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.functions import bands, clip, elapsed_days, elapsed_hours, exact, exact_avg, ladder, score
from viewmart.operators import any_of, attach_lookup, has, unique_names, with_globals
from viewmart.plans.billing import ticket_metrics
from viewmart.session import settle


def _by(tickets: DataFrame, key: str):
    return tickets.where(F.col(key).isNotNull()).groupBy(key)


def _part_of_most(measure: str) -> Column:
    """A measure as a fraction of its largest value over all groups."""
    return F.try_divide(F.col(measure), F.col(f"_most_{measure}"))


def _with_most(stats: DataFrame, *measures: str) -> DataFrame:
    return with_globals(stats, stats, **{f"_most_{name}": F.max(name) for name in measures})


# --- per-technician, per-model and per-department tables ---------------------------------

#: Optional yes/no and number columns whose averages the group tables need.
_FLAGS = ["First_Contact_Resolution", "Remote_Resolution_Attempted", "Escalation_Flag"]
_NUMBERS = ["Resolution_Time_Hrs", "Customer_Satisfaction_Rating", "Cost_Of_Resolution"]


def work_cells(tickets: DataFrame) -> DataFrame:
    """Sums and counts per technician and equipment model, NULL keys kept.

    Technicians, models and the mean over all tickets add up from it, so gold operations reads
    the tickets twice: here and for its rows.
    """
    parts = [F.count("Ticket_ID").alias("tickets"), F.count("*").alias("rows")]
    for name in [*_NUMBERS, *_FLAGS]:
        if has(tickets, name):
            value = F.col(name).cast("int") if name in _FLAGS else exact(F.col(name))
            parts += [F.sum(value).alias(f"sum_{name}"), F.count(value).alias(f"n_{name}")]
    if has(tickets, "Priority_Level"):
        parts.append(F.count_if(F.col("Priority_Level") == "High").alias("high"))
    return tickets.groupBy("Technician_Assigned", "Equipment_Model").agg(*parts)


def _mean(cells: DataFrame, name: str, instead: object) -> Column:
    return any_of(cells, f"n_{name}", lambda n: F.try_divide(F.sum(f"sum_{name}").cast("double"), F.sum(n)), instead)


def technicians_of(cells: DataFrame) -> DataFrame:
    """Measures per technician, from ``work_cells``."""
    return (
        _by(cells, "Technician_Assigned")
        .agg(
            F.sum("tickets").alias("Tickets_Count"),
            _mean(cells, "Resolution_Time_Hrs", None).alias("Avg_Resolution_Time"),
            _mean(cells, "Customer_Satisfaction_Rating", fv.DEFAULT_RATING).alias("Avg_Satisfaction"),
            _mean(cells, "First_Contact_Resolution", fv.DEFAULT_FIRST_CONTACT_RATE).alias("FCR_Rate"),
            _mean(cells, "Remote_Resolution_Attempted", fv.DEFAULT_REMOTE_RATE).alias("Remote_Resolution_Rate"),
            _mean(cells, "Cost_Of_Resolution", fv.DEFAULT_COST).alias("Cost_Per_Ticket"),
        )
        .fillna(0)
    )


def technician_stats(tickets: DataFrame) -> DataFrame:
    return technicians_of(work_cells(tickets))


def performance_tier() -> Column:
    overall = F.col("Overall_Performance_Score")
    return ladder([(overall >= low, label) for low, label in fv.PERFORMANCE_AT_LEAST], fv.PERFORMANCE_OTHER)


def technician_scores(stats: DataFrame) -> DataFrame:
    """Four scores per technician, their weighted sum (of the truncated scores) and its tier.

    ``stats`` should be settled: its rows and its maxima are both read.
    """
    overall = None
    for name, weight in fv.TECHNICIAN_WEIGHTS:
        part = F.col(name) * weight
        overall = part if overall is None else overall + part
    return (
        _with_most(stats, "Avg_Resolution_Time", "Cost_Per_Ticket")
        .withColumns(
            {
                "Speed_Score": score(clip(100 - _part_of_most("Avg_Resolution_Time") * 100)),
                "Satisfaction_Score": score(clip(F.col("Avg_Satisfaction") / 5 * 100)),
                "FCR_Score": score(clip(F.col("FCR_Rate") * 100)),
                "Cost_Efficiency_Score": score(clip(100 - _part_of_most("Cost_Per_Ticket") * 100)),
            }
        )
        .withColumn("Overall_Performance_Score", score(overall))
        .withColumn("Performance_Tier", performance_tier())
        .drop("_most_Avg_Resolution_Time", "_most_Cost_Per_Ticket")
    )


def equipment_of(cells: DataFrame) -> DataFrame:
    """Measures per equipment model, from ``work_cells``."""
    return (
        _by(cells, "Equipment_Model")
        .agg(
            F.sum("tickets").alias("Total_Issues"),
            _mean(cells, "Resolution_Time_Hrs", None).alias("Avg_Resolution_Time"),
            any_of(cells, "high", lambda n: F.sum(n) / F.sum("rows"), fv.DEFAULT_HIGH_PRIORITY_RATE).alias("High_Priority_Rate"),
            _mean(cells, "Escalation_Flag", fv.DEFAULT_ESCALATION_RATE).alias("Escalation_Rate"),
        )
        .fillna(0)
    )


def equipment_stats(tickets: DataFrame) -> DataFrame:
    return equipment_of(work_cells(tickets))


def equipment_reliability(stats: DataFrame) -> DataFrame:
    index = 100 - _part_of_most("Total_Issues") * 40 - F.col("Escalation_Rate") * 60
    return (
        _with_most(stats, "Total_Issues")
        .withColumn("Reliability_Index", score(clip(index)))
        .drop("_most_Total_Issues")
    )


def department_stats(tickets: DataFrame) -> DataFrame:
    return (
        _by(tickets, "Department")
        .agg(
            F.count("Ticket_ID").alias("Tickets_Handled"),
            F.avg("Resolution_Time_Hrs").alias("Avg_Resolution"),
            any_of(tickets, "Customer_Satisfaction_Rating", exact_avg, fv.DEFAULT_RATING).alias("Satisfaction_Avg"),
        )
        .fillna(0)
    )


def department_efficiency(stats: DataFrame) -> DataFrame:
    return (
        _with_most(stats, "Avg_Resolution")
        .withColumn("Dept_Efficiency", score(clip(100 - _part_of_most("Avg_Resolution") * 100)))
        .drop("_most_Avg_Resolution")
    )


# --- the group results on each ticket ----------------------------------------------------


def with_technicians(df: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` are ``work_cells``."""
    scored = technician_scores(settle(technicians_of(cells), "technicians"))
    lookup = scored.select("Technician_Assigned", "Overall_Performance_Score", "Performance_Tier")
    return attach_lookup(df, lookup, "Technician_Assigned")


def with_equipment(df: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` are ``work_cells``."""
    rated = equipment_reliability(settle(equipment_of(cells), "equipment"))
    lookup = rated.select("Equipment_Model", "Reliability_Index")
    return attach_lookup(df, lookup, "Equipment_Model")


def with_departments(df: DataFrame, tickets: DataFrame) -> DataFrame:
    rated = department_efficiency(settle(department_stats(tickets), "departments"))
    lookup = rated.select("Department", "Dept_Efficiency")
    return attach_lookup(df, lookup, "Department")


# --- per-ticket KPIs ---------------------------------------------------------------------


def with_resolution_efficiency(df: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` are ``work_cells``, which hold the mean over all tickets."""
    faster = F.col("Resolution_Time_Hrs") < F.col("_mean")
    averaged = with_globals(df, cells, _mean=_mean(cells, "Resolution_Time_Hrs", None))
    return averaged.withColumn("Resolution_Efficiency", F.when(faster, "High").otherwise("Low")).drop("_mean")


def resolution_band() -> Column:
    return bands(F.col("Resolution_Time_Hrs"), fv.RESOLUTION_BANDS, closed="right")


def signal_quality() -> Column:
    signal = F.col("Signal_Strength_dBm")
    return ladder([(signal >= low, label) for low, label in fv.SIGNAL_AT_LEAST], fv.SIGNAL_OTHER)


def response_sla(tickets: DataFrame) -> Column:
    if not has(tickets, "Priority_Level"):
        return F.lit(fv.DEFAULT_SLA)
    level = F.col("Priority_Level")
    return ladder([(level == name, text) for name, text in fv.SLA_TEXT.items()], fv.SLA_TEXT_OTHER)


def with_sla(tickets: DataFrame) -> DataFrame:
    """Response target, hours and days taken, and whether the priority's target was met."""
    df = tickets.withColumn("Priority_Response_SLA", response_sla(tickets))
    if not has(tickets, "Created_Date", "Resolved_Date"):
        return df
    start, end = F.col("Created_Date"), F.col("Resolved_Date")
    df = df.withColumn("Actual_Resolution_Hours", elapsed_hours(start, end))
    if not has(tickets, "Priority_Level"):
        return df
    level = F.col("Priority_Level")
    allowed = ladder([(level == name, hours) for name, hours in fv.SLA_HOURS.items()], fv.SLA_HOURS_OTHER)
    return df.withColumns(
        {
            "SLA_Met": F.coalesce(F.col("Actual_Resolution_Hours") <= allowed, F.lit(False)),
            "Days_To_Resolve": elapsed_days(start, end),
        }
    )


def impact_score(df: DataFrame) -> Column:
    """A constant, unless the tickets carry their customer's measures."""
    if not has(df, "Total_Tickets", "Avg_Satisfaction"):
        return F.lit(fv.DEFAULT_IMPACT)
    still_open = F.when(F.lower("Status") == "closed", 0).otherwise(25)
    escalated = any_of(df, "Escalation_Flag", lambda flag: F.when(flag, 25).otherwise(0), 0)
    volume = clip(F.coalesce("Total_Tickets", F.lit(0)), 0, 50)
    unhappy = 100 - clip(F.coalesce("Avg_Satisfaction", F.lit(5.0)) * 20)
    return score(still_open + escalated + volume + unhappy)


def tickets_with_customer_metrics(tickets: DataFrame) -> DataFrame:
    """Each ticket with its customer's volume and satisfaction, for the full impact score."""
    metrics = settle(ticket_metrics(tickets), "ticket-metrics")
    lookup = metrics.select("Customer_ID", "Total_Tickets", "Avg_Satisfaction")
    return attach_lookup(tickets, lookup, "Customer_ID")


def enrich_tickets(tickets: DataFrame) -> DataFrame:
    """Every ticket KPI that the gold table keeps."""
    cells = settle(work_cells(tickets), "work-cells")
    df = with_resolution_efficiency(tickets, cells)
    df = with_equipment(with_technicians(df, cells), cells)
    return df.withColumns(
        {
            "Issue_Resolution_Time": resolution_band(),
            "Signal_Quality": signal_quality(),
            "Issue_Impact_Score": impact_score(tickets),
        }
    )


def gold_operations(tickets: DataFrame) -> DataFrame:
    df = enrich_tickets(tickets)
    names = [name if has(df, name) else instead for name, instead in fv.GOLD_OPERATIONS]
    return df.select(unique_names(names))
