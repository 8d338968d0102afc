"""One SQL text per query name."""

from oracle.tables import RESOLUTION_BAND, SIGNAL_QUALITY, EFFICIENCY, AS_OF, clip, flag, score, title, with_tables

ORACLES: dict[str, str] = {}

KEYS = "Program_Genre, Channel_Name, Device_Type, Stream_Quality"
BILLING_FRACTIONS = """Monthly_Bill Monthly_Revenue Customer_Tenure_Years Avg_Resolution_Time Avg_Satisfaction FCR_Rate
 Avg_Signal_Strength Customer_Lifetime_Value"""
CONTENT_FRACTIONS = "Total_Engagement_Hours Average_View_Duration_Mins Avg_Buffering_Events Avg_User_Rating"
OPERATIONS_FRACTIONS = "Customer_Satisfaction_Rating Cost_Of_Resolution"
METRIC_FRACTIONS = "Avg_Resolution_Time Avg_Satisfaction FCR_Rate Avg_Signal_Strength"
SCORE_FRACTIONS = "Avg_Resolution_Time Avg_Satisfaction FCR_Rate Remote_Resolution_Rate"


def query(name: str, body: str, fractions: str = "") -> None:
    """Register; the named fraction columns are rounded to six digits."""
    if fractions:
        rounded = ", ".join(f"round({column}, 6) AS {column}" for column in fractions.split())
        body = f"SELECT * REPLACE ({rounded}) FROM ({body})"
    ORACLES[name] = with_tables(body)


def counts(column: str, table: str, name: str | None = None) -> str:
    return (
        f'SELECT {column} AS {name or column}, count(*) AS "Count" FROM {table} WHERE {column} IS NOT NULL GROUP BY 1'
    )


def histogram(column: str, table: str, bins: int, low: str | None = None, high: str | None = None) -> str:
    low, high = low or f"min({column})", high or f"max({column})"
    return f"""
SELECT Bin, low + Bin * w AS Bin_Start, low + (Bin + 1) * w AS Bin_End, count(*) AS "Count", Mean
FROM (
  SELECT low, w, Mean, CAST(greatest(0, least({bins - 1}, coalesce(floor((x - low) / nullif(w, 0)), 0))) AS INTEGER) AS Bin
  FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL) CROSS JOIN (
    SELECT CAST({low} AS DOUBLE) AS low, (CAST({high} AS DOUBLE) - CAST({low} AS DOUBLE)) / {bins}e0 AS w,
      avg({column}) AS Mean FROM {table}))
GROUP BY Bin, low, w, Mean"""


HIST_FRACTIONS = "Bin_Start Bin_End Mean"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# sources, sinks, layer jobs
query("scan_customers", "SELECT * EXCLUDE (ingest_seq) FROM bronze_customers", "Monthly_Bill Customer_Lifetime_Value")
query("scan_tickets", "SELECT * FROM bronze_tickets", "Signal_Strength_dBm Customer_Satisfaction_Rating Cost_Of_Resolution")
query(
    "unreadable_values",
    "SELECT 'customers' AS Table_Name, 'Monthly_Bill' AS Column_Name, count(*) AS Bad_Values FROM bronze_customers"
    " WHERE Customer_ID % 11 IN (5, 7) HAVING count(*) > 0",
)
ORACLES["observed_unreadable"] = ORACLES["unreadable_values"]
query("scan_logs", "SELECT * FROM bronze_logs", "Buffering_Events User_Rating")
query("scan_foreign_customers", "SELECT * EXCLUDE (ingest_seq) FROM bronze_customers", "Monthly_Bill Customer_Lifetime_Value")

DATE_WAYS = {
    "yyyy-M-d": "%Y-%m-%d", "yyyy/M/d": "%Y/%m/%d", "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y", "d.M.yyyy": "%d.%m.%Y",
    "d-M-yyyy": "%d-%m-%Y", "yyyyMMdd": "%Y%m%d", "d MMM yyyy": "%d %b %Y", "MMM d, yyyy": "%b %d, %Y",
}
WRITTEN_DATES = {"Join_Date": "%m/%d/%Y", "Contract_End": "%d.%m.%Y", "Last_Payment_Date": "%Y-%m-%d"}


def format_rows() -> str:
    """A row for each column, way of writing and cell: the value, or NULL where it cannot be read so."""
    parts = [
        f"SELECT '{column}' AS Column_Name, '{way}' AS Format, {place} AS place,"
        f" epoch(try_strptime(strftime({column}, '{written}'), '{pattern}')) AS v FROM bronze_customers WHERE {column} IS NOT NULL"
        for column, written in WRITTEN_DATES.items()
        for place, (way, pattern) in enumerate(DATE_WAYS.items())
    ]
    for column, decimal in (("Monthly_Bill", ","), ("Customer_Lifetime_Value", ".")):
        text = f"replace(CAST({column} AS VARCHAR), '.', '{decimal}')"
        for place, (way, group, point) in enumerate((("1,234.5", ",", "."), ("1.234,5", ".", ","))):
            shape = rf"[+-]?([0-9]{{1,3}}(\{group}[0-9]{{3}})+|[0-9]+)(\{point}[0-9]*)?"
            value = f"TRY_CAST(replace(replace({text}, '{group}', ''), '{point}', '.') AS DOUBLE)"
            parts.append(
                f"SELECT '{column}', '{way}', {place}, CASE WHEN regexp_full_match({text}, '{shape}') THEN {value} END"
                f" FROM bronze_customers WHERE {column} IS NOT NULL"
            )
    return union(parts)


query(
    "scan_formats",
    f"""
SELECT Column_Name, Format, Cells, Unread, place = best.place AS Chosen,
  bool_or(Unread = best.Unread AND Unread < Cells AND mark <> best.mark) OVER (PARTITION BY Column_Name) AS Ambiguous
FROM (
  SELECT *, min({{'Unread': Unread, 'place': place, 'mark': mark}}) OVER (PARTITION BY Column_Name) AS best FROM (
    SELECT Column_Name, Format, place, count(*) AS Cells, count(*) - count(v) AS Unread, coalesce(sum(v), 0) AS mark
    FROM ({format_rows()}) GROUP BY 1, 2, 3))""",
)


def contents(pairs: list[tuple[str, str]]) -> str:
    """Rows, values and an order-free checksum of every column of each table."""
    every = "COLUMNS('(.*)')"
    text = (
        f"CASE WHEN typeof({every}) = 'DOUBLE' THEN CAST(CAST(round(TRY_CAST(CAST({every} AS VARCHAR) AS DOUBLE) * 1e4) AS HUGEINT)"
        f" AS VARCHAR) ELSE CAST({every} AS VARCHAR) END AS \"\\1\""
    )
    return union(
        [
            f"SELECT '{name}' AS Table_Name, column_name AS Column_Name, count(*) AS Row_Count, count(v) AS Non_Null,"
            " CAST(coalesce(sum(CAST('0x' || substr(md5(v), 1, 8) AS BIGINT)), 0) AS BIGINT) AS Checksum"
            f" FROM (SELECT {text} FROM {table}) UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(*))) GROUP BY 2"
            for name, table in pairs
        ]
    )


GOLD = [
    ("billing_segmentation", "gold_billing"),
    ("content_strategy", "gold_content"),
    ("network_operations", "gold_operations"),
]
query("write_layer", contents([("customers", "(SELECT * EXCLUDE (ingest_seq) FROM bronze_customers)"), ("tickets", "bronze_tickets"), ("viewing_logs", "bronze_logs")]))
query("layer_silver", contents([("customers", "silver_customers"), ("tickets", "silver_tickets"), ("viewing_logs", "silver_logs")]))
query("layer_gold", contents(GOLD))
query("layer_all", contents(GOLD))

# cleaning rules
_titled = ["Status", "Equipment_Model", "Issue_Category", "Department", "Technician_Assigned"]
query(
    "title_case",
    f"SELECT Ticket_ID, {', '.join(_titled)}, "
    + ", ".join(f"{title(name)} AS {name}_Title" for name in _titled)
    + " FROM bronze_tickets",
)
query(
    "clamp_future_join",
    f"SELECT Customer_ID, ingest_seq, CASE WHEN Join_Date > {AS_OF} THEN {AS_OF} ELSE Join_Date END AS Join_Date"
    " FROM bronze_customers",
)
query(
    "dedup_customers",
    "SELECT Customer_ID, ingest_seq, Name, Monthly_Bill FROM bronze_customers"
    " QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY ingest_seq) = 1",
    "Monthly_Bill",
)


def imputed(name: str, table: str, key: str, column: str, statistic: str) -> None:
    query(
        name,
        f"SELECT {key}, coalesce({column}, (SELECT {statistic} FROM {table})) AS {column} FROM {table}",
        column,
    )


imputed("impute_monthly_bill", "bronze_customers", "ingest_seq", "Monthly_Bill", "quantile_cont(Monthly_Bill, 0.5)")
imputed("impute_signal", "bronze_tickets", "Ticket_ID", "Signal_Strength_dBm", "CAST(sum(CAST(Signal_Strength_dBm AS DECIMAL(28, 6))) AS DOUBLE) / count(Signal_Strength_dBm)")
imputed(
    "impute_satisfaction", "bronze_tickets", "Ticket_ID", "Customer_Satisfaction_Rating",
    "quantile_cont(Customer_Satisfaction_Rating, 0.5)",
)
imputed("impute_buffering", "bronze_logs", "Log_ID", "Buffering_Events", "CAST(sum(CAST(Buffering_Events AS DECIMAL(28, 6))) AS DOUBLE) / count(Buffering_Events)")
imputed("impute_rating", "bronze_logs", "Log_ID", "User_Rating", "quantile_cont(User_Rating, 0.5)")
query("guard_defaults", "SELECT * FROM bare_technician_scores", SCORE_FRACTIONS)

# silver
query("silver_customers", "SELECT * FROM silver_customers", "Monthly_Bill Customer_Lifetime_Value")
query("silver_tickets", "SELECT * FROM silver_tickets", "Signal_Strength_dBm Customer_Satisfaction_Rating Cost_Of_Resolution")
query("silver_logs", "SELECT * FROM silver_logs", "Buffering_Events User_Rating")

# gold billing
query("customer_ticket_metrics", "SELECT * FROM ticket_metrics", METRIC_FRACTIONS)
query("customer_ticket_join", "SELECT * FROM joined_customers", METRIC_FRACTIONS + " Monthly_Bill Customer_Lifetime_Value")


def customer(name: str, columns: str, fractions: str = "") -> None:
    query(name, f"SELECT Customer_ID, {columns} FROM customer_kpis", fractions)


customer("customer_tenure", "Customer_Tenure_Years", "Customer_Tenure_Years")
customer("bill_category", "Bill_Category")
customer("monthly_revenue", "Monthly_Revenue", "Monthly_Revenue")
customer("service_health_score", "Service_Health_Score")
customer("payment_days", "Payment_Days_Overdue")
customer("payment_risk_score", "Payment_Status, Payment_Days_Overdue, Payment_Risk_Score")
customer("churn_risk", "Service_Health_Score, Calculated_Churn_Risk")
customer("ltv_index", "LTV_Index")
customer("loyalty_index", "Loyalty_Index")
customer("device_adoption_score", "Device_Adoption_Score")
customer("contract_renewal_risk", "Days_Until_Contract_End, Contract_Renewal_Risk")
customer("revenue_health", "Revenue_Health")
customer("customer_segment", "Service_Health_Score, LTV_Index, Customer_Segment")
query("gold_billing", "SELECT * FROM gold_billing", BILLING_FRACTIONS)

# gold operations
query("technician_stats", "SELECT * FROM technician_stats", SCORE_FRACTIONS + " Cost_Per_Ticket")
query("technician_scores", "SELECT * FROM technician_scores", SCORE_FRACTIONS + " Cost_Per_Ticket")
query("performance_tier", "SELECT Technician_Assigned, Overall_Performance_Score, Performance_Tier FROM technician_scores")
query("equipment_stats", "SELECT * FROM equipment_stats", "Avg_Resolution_Time High_Priority_Rate Escalation_Rate")
query("equipment_reliability", "SELECT * FROM equipment_reliability", "Avg_Resolution_Time High_Priority_Rate Escalation_Rate")
query("department_stats", "SELECT * FROM department_stats", "Avg_Resolution Satisfaction_Avg")
query("department_efficiency", "SELECT * FROM department_efficiency", "Avg_Resolution Satisfaction_Avg")
query(
    "ticket_technician_join",
    "SELECT Ticket_ID, t.Technician_Assigned, Overall_Performance_Score, Performance_Tier FROM silver_tickets t"
    " LEFT JOIN technician_scores s ON t.Technician_Assigned = s.Technician_Assigned",
)
query(
    "ticket_equipment_join",
    "SELECT Ticket_ID, t.Equipment_Model, Reliability_Index FROM silver_tickets t"
    " LEFT JOIN equipment_reliability e ON t.Equipment_Model = e.Equipment_Model",
)
query(
    "ticket_department_join",
    "SELECT Ticket_ID, t.Department, Dept_Efficiency FROM silver_tickets t"
    " LEFT JOIN department_efficiency d ON t.Department = d.Department",
)
query("resolution_efficiency", f"SELECT Ticket_ID, Resolution_Time_Hrs, {EFFICIENCY} AS Resolution_Efficiency FROM silver_tickets")
query("issue_resolution_bucket", f"SELECT Ticket_ID, Resolution_Time_Hrs, {RESOLUTION_BAND} AS Issue_Resolution_Time FROM silver_tickets")
query(
    "signal_quality",
    f"SELECT Ticket_ID, Signal_Strength_dBm, {SIGNAL_QUALITY} AS Signal_Quality FROM silver_tickets",
    "Signal_Strength_dBm",
)
query(
    "priority_sla",
    "SELECT Ticket_ID, Priority_Level, CASE Priority_Level WHEN 'Critical' THEN '<4h' WHEN 'High' THEN '<8h'"
    " WHEN 'Medium' THEN '<24h' ELSE '<72h' END AS Priority_Response_SLA FROM silver_tickets",
)
query(
    "sla_compliance",
    """SELECT Ticket_ID, us / 3600e6 AS Actual_Resolution_Hours,
  coalesce(us / 3600e6 <= CASE Priority_Level WHEN 'Critical' THEN 4 WHEN 'High' THEN 8 WHEN 'Medium' THEN 24
    ELSE 72 END, false) AS SLA_Met,
  CAST(floor(us / 86400e6) AS BIGINT) AS Days_To_Resolve
FROM (SELECT *, epoch_us(Resolved_Date) - epoch_us(Created_Date) AS us FROM silver_tickets)""",
    "Actual_Resolution_Hours",
)
query("issue_impact_score", "SELECT Ticket_ID, 50 AS Issue_Impact_Score FROM silver_tickets")
_impact = score(
    "CASE WHEN lower(Status) = 'closed' THEN 0 ELSE 25 END + CASE WHEN Escalation_Flag THEN 25 ELSE 0 END"
    f" + {clip('coalesce(Total_Tickets, 0)', '0e0', '50e0')} + (100 - {clip('coalesce(Avg_Satisfaction, 5) * 20')})"
)
query(
    "issue_impact_score_joined",
    f"SELECT Ticket_ID, {_impact} AS Issue_Impact_Score FROM silver_tickets t"
    " LEFT JOIN ticket_metrics m ON t.Customer_ID = m.Customer_ID",
)
query("gold_operations", "SELECT * FROM gold_operations", OPERATIONS_FRACTIONS)

# gold content
query("content_agg", "SELECT * FROM content_agg", "Average_View_Duration_Mins Avg_Buffering_Events Avg_User_Rating")
query("genre_performance", "SELECT * FROM genre_performance", "Genre_Avg_Duration Genre_Avg_Rating")
query("device_performance", "SELECT * FROM device_performance", "Device_Avg_Duration Device_Avg_Buffering")
query("content_type_performance", "SELECT * FROM content_type_performance", "ContentType_Avg_Duration")
query(
    "quality_analysis",
    "SELECT Stream_Quality, count(Log_ID) AS Quality_View_Count, avg(Buffering_Events) AS Quality_Avg_Buffering,"
    " avg(User_Rating) AS Quality_Avg_Rating FROM silver_logs WHERE Stream_Quality IS NOT NULL GROUP BY 1",
    "Quality_Avg_Buffering Quality_Avg_Rating",
)
query(
    "peak_analysis",
    "SELECT CAST(hour(Start_Time) AS INTEGER) AS Hour_Of_Day, count(Log_ID) AS Peak_Views,"
    " avg(View_Duration_Mins) AS Peak_Duration FROM silver_logs WHERE Start_Time IS NOT NULL GROUP BY 1",
    "Peak_Duration",
)
query(
    "viewing_calendar",
    "SELECT Log_ID, CAST(hour(Start_Time) AS INTEGER) AS Hour_Of_Day, dayname(Start_Time) AS Day_Of_Week FROM silver_logs",
)
query(
    "logs_content_type_join",
    "SELECT Log_ID, l.Content_Type, Customer_ID, View_Duration_Mins, ContentType_Views, ContentType_Unique_Viewers,"
    " ContentType_Avg_Duration FROM silver_logs l LEFT JOIN content_type_performance p ON l.Content_Type = p.Content_Type",
    "ContentType_Avg_Duration",
)
query("content_genre_join", f"SELECT {KEYS}, Genre_Strength_Index FROM gold_content")
query("content_device_join", f"SELECT {KEYS}, Device_Adoption_Index FROM gold_content")


def cell(name: str, columns: str, fractions: str = "") -> None:
    query(name, f"SELECT {KEYS}, {columns} FROM gold_content", fractions)


cell("engagement_hours", "Total_Engagement_Hours", "Total_Engagement_Hours")
cell("engagement_score", "Engagement_Score")
cell("quality_satisfaction", "Quality_Satisfaction")
cell("popularity_tier", "Total_Views, Popularity_Tier")
cell("customer_penetration", "Customer_Penetration")
query("genre_strength_index", "SELECT * FROM genre_strength")
query("device_adoption_index", "SELECT * FROM device_adoption")
cell("content_health", "Engagement_Score, Content_Health")
cell("viewing_frequency", "Viewing_Frequency")
cell("content_reach_score", "Content_Reach_Score")
cell("ad_opportunity_score", "Ad_Opportunity_Score")
query("gold_content", "SELECT * FROM gold_content", CONTENT_FRACTIONS)


# dashboard 1: billing
def options(table: str, *columns: str) -> str:
    return union([f"SELECT DISTINCT '{name}' AS Filter, {name} AS Option FROM {table}" for name in columns])


D1 = "(SELECT * FROM gold_billing WHERE Region IN ('ASIA', 'EUROPE') AND Customer_Segment IN ('VIP_Advocates', 'Standard'))"


def region(table: str) -> str:
    return (
        f"SELECT Region, sum(Monthly_Bill) AS Total_Revenue, count(Customer_ID) AS Customer_Count FROM {table}"
        " WHERE Region IS NOT NULL GROUP BY Region"
    )


query("d1_options", options("gold_billing", "Region", "Customer_Segment"))
query("d1_filtered", f"SELECT * FROM {D1}", BILLING_FRACTIONS)
query("d1_filtered_revenue_by_region", region(D1), "Total_Revenue")
query(
    "d1_financial_kpis",
    "SELECT sum(Monthly_Bill) AS Total_Monthly_Revenue, sum(Monthly_Bill) * 12 AS Annual_Revenue,"
    " count(*) AS Active_Customers, avg(Monthly_Bill) AS Avg_Monthly_Bill FROM gold_billing",
    "Total_Monthly_Revenue Annual_Revenue Avg_Monthly_Bill",
)
query(
    "d1_health_kpis",
    "SELECT avg(Service_Health_Score) AS Avg_Health_Score,"
    " count(*) FILTER (WHERE Payment_Status = 'Paid') AS Customers_In_Good_Standing,"
    " count(*) FILTER (WHERE Calculated_Churn_Risk = 'High') AS High_Churn_Risk_Count,"
    " avg(Customer_Lifetime_Value) AS Avg_Customer_LTV FROM gold_billing",
    "Avg_Health_Score Avg_Customer_LTV",
)
query("d1_revenue_by_region", region("gold_billing"), "Total_Revenue")
query("d1_bill_category_dist", counts("Bill_Category", "gold_billing"))
query(
    "d1_revenue_by_bill_category",
    "SELECT Bill_Category, sum(Monthly_Bill) AS Monthly_Bill FROM gold_billing WHERE Bill_Category IS NOT NULL GROUP BY 1",
    "Monthly_Bill",
)
query("d1_health_hist", histogram("Service_Health_Score", "gold_billing", 20, "0", "100"), HIST_FRACTIONS)
query("d1_churn_dist", counts("Calculated_Churn_Risk", "gold_billing", "Churn_Risk"))
query("d1_payment_dist", counts("Payment_Status", "gold_billing"))
query("d1_contract_dist", counts("Contract_Renewal_Risk", "gold_billing", "Contract_Risk"))
query(
    "d1_loyalty_ltv",
    "SELECT Customer_ID, Loyalty_Index, LTV_Index, Monthly_Bill, Service_Health_Score FROM gold_billing",
    "Monthly_Bill",
)
query("d1_device_hist", histogram("Device_Adoption_Score", "gold_billing", 15, "0", "100"), HIST_FRACTIONS)
query("d1_segment_dist", counts("Customer_Segment", "gold_billing", "Segment"))
query(
    "d1_segment_revenue",
    "SELECT Customer_Segment AS Segment, sum(Monthly_Bill) AS Revenue FROM gold_billing GROUP BY 1",
    "Revenue",
)
query(
    "d1_detail",
    "SELECT Customer_ID, Name, Region, Monthly_Bill, Service_Tier, Service_Health_Score, Payment_Status,"
    " Calculated_Churn_Risk, Customer_Segment FROM gold_billing",
    "Monthly_Bill",
)

# dashboard 2: content
D2 = "(SELECT * FROM gold_content WHERE Program_Genre IN ('Click', 'Error') AND Device_Type IN ('Tablet'))"


def content_kpis(table: str) -> str:
    return (
        "SELECT CAST(sum(Total_Views) AS BIGINT) AS Total_Views, sum(Total_Engagement_Hours) AS Total_Engagement_Hours,"
        f" avg(Unique_Customer_Count) AS Avg_Unique_Viewers, avg(Avg_User_Rating) AS Avg_User_Rating FROM {table}"
    )


CONTENT_KPI_FRACTIONS = "Total_Engagement_Hours Avg_Unique_Viewers Avg_User_Rating"
query("d2_options", options("gold_content", "Program_Genre", "Device_Type"))
query("d2_filtered", f"SELECT * FROM {D2}", CONTENT_FRACTIONS)
query("d2_filtered_kpis", content_kpis(D2), CONTENT_KPI_FRACTIONS)
query("d2_kpis", content_kpis("gold_content"), CONTENT_KPI_FRACTIONS)
query(
    "d2_genre_duration",
    "SELECT Program_Genre, CAST(sum(Total_View_Duration_Mins) AS BIGINT) AS Total_View_Duration_Mins,"
    " CAST(sum(Total_Views) AS BIGINT) AS Total_Views FROM gold_content GROUP BY 1",
)
query(
    "d2_device_views",
    "SELECT Device_Type, CAST(sum(Total_Views) AS BIGINT) AS Total_Views,"
    " CAST(sum(Unique_Customer_Count) AS BIGINT) AS Unique_Customer_Count FROM gold_content GROUP BY 1",
)
query("d2_engagement_hist", histogram("Engagement_Score", "gold_content", 15, "0", "100"), HIST_FRACTIONS)
query("d2_quality_dist", counts("Quality_Satisfaction", "gold_content", "Quality"))
query("d2_popularity_dist", counts("Popularity_Tier", "gold_content", "Tier"))
query("d2_health_dist", counts("Content_Health", "gold_content", "Health"))
query(
    "d2_reach_top",
    "SELECT Channel_Name, avg(Content_Reach_Score) AS Content_Reach_Score FROM"
    f" (SELECT * FROM gold_content ORDER BY Content_Reach_Score DESC, {KEYS} LIMIT 15) GROUP BY 1",
    "Content_Reach_Score",
)
query(
    "d2_engagement_rating",
    "SELECT Program_Genre, Channel_Name, Engagement_Score, Avg_User_Rating, Total_Views, Content_Health FROM gold_content",
    "Avg_User_Rating",
)
query(
    "d2_top_viewed",
    "SELECT Channel_Name, Total_Views, Engagement_Score, Avg_User_Rating FROM gold_content"
    f" ORDER BY Total_Views DESC, {KEYS} LIMIT 10",
    "Avg_User_Rating",
)
query(
    "d2_top_rated",
    "SELECT Channel_Name, Avg_User_Rating, Engagement_Score, Total_Views FROM gold_content"
    f" ORDER BY Avg_User_Rating DESC, {KEYS} LIMIT 10",
    "Avg_User_Rating",
)
query(
    "d2_detail",
    "SELECT Program_Genre, Channel_Name, Device_Type, Total_Views, Unique_Customer_Count, Avg_User_Rating,"
    " Engagement_Score, Content_Health, Content_Reach_Score FROM gold_content",
    "Avg_User_Rating",
)

# dashboard 3: operations
D3 = "(SELECT * FROM gold_operations WHERE Equipment_Model IN ('4K Mini', 'Relay') AND Department IN ('Billing', 'Sales'))"


def departments(table: str) -> str:
    return f"""
SELECT Department, Tickets, Measure, Value FROM (
  SELECT Department, count(Ticket_ID) AS Tickets, avg(Resolution_Time_Hrs) AS Avg_Resolution_Hrs,
    avg(Customer_Satisfaction_Rating) AS Avg_Satisfaction, avg(Overall_Performance_Score) AS Avg_Performance
  FROM {table} WHERE Department IS NOT NULL GROUP BY Department)
UNPIVOT (Value FOR Measure IN (Avg_Resolution_Hrs, Avg_Satisfaction, Avg_Performance))"""


query("d3_options", options("gold_operations", "Equipment_Model", "Department"))
query("d3_filtered", f"SELECT * FROM {D3}", OPERATIONS_FRACTIONS)
query("d3_filtered_null", "SELECT * FROM gold_operations WHERE Department IS NULL OR Department = 'Billing'", OPERATIONS_FRACTIONS)
query("d3_filtered_department_perf", departments(D3), "Value")
query(
    "d3_kpis",
    "SELECT count(*) AS Total_Service_Tickets, avg(Resolution_Time_Hrs) AS Avg_Resolution_Time,"
    " count(*) FILTER (WHERE Performance_Tier = 'Expert') AS Expert_Technicians,"
    " avg(Customer_Satisfaction_Rating) AS Avg_Satisfaction_Rating FROM gold_operations",
    "Avg_Resolution_Time Avg_Satisfaction_Rating",
)
query("d3_resolution_hist", histogram("Resolution_Time_Hrs", "gold_operations", 20), HIST_FRACTIONS)
query("d3_efficiency_dist", counts("Resolution_Efficiency", "gold_operations", "Efficiency"))
query("d3_tier_dist", counts("Performance_Tier", "gold_operations", "Tier"))
query("d3_score_hist", histogram("Overall_Performance_Score", "gold_operations", 20, "0", "100"), HIST_FRACTIONS)
query("d3_equipment_dist", counts("Equipment_Model", "gold_operations", "Equipment"))
query(
    "d3_reliability",
    "SELECT Equipment_Model, avg(Reliability_Index) AS Reliability_Index FROM gold_operations GROUP BY 1",
    "Reliability_Index",
)
query("d3_issue_dist", counts("Issue_Category", "gold_operations", "Category"))
query("d3_impact_hist", histogram("Issue_Impact_Score", "gold_operations", 15, "0", "100"), HIST_FRACTIONS)
query("d3_signal_dist", counts("Signal_Quality", "gold_operations", "Quality"))
query(
    "d3_satisfaction_resolution",
    "SELECT Ticket_ID, Resolution_Time_Hrs, Customer_Satisfaction_Rating, Issue_Impact_Score, Performance_Tier"
    " FROM gold_operations",
    "Customer_Satisfaction_Rating",
)
query("d3_department_perf", departments("gold_operations"), "Value")
query(
    "d3_detail",
    "SELECT Ticket_ID, Customer_ID, Equipment_Model, Issue_Category, Status, Resolution_Time_Hrs, Performance_Tier,"
    " Overall_Performance_Score, Customer_Satisfaction_Rating, Signal_Quality FROM gold_operations",
    "Customer_Satisfaction_Rating",
)

# executive summary
query(
    "exec_overview",
    "SELECT * FROM (SELECT count(*) AS Total_Customers, sum(Monthly_Bill) AS Monthly_Revenue FROM gold_billing),"
    " (SELECT avg(Customer_Satisfaction_Rating) AS Avg_Customer_Satisfaction FROM gold_operations),"
    " (SELECT CAST(sum(Total_Views) AS BIGINT) AS Total_Content_Views FROM gold_content)",
    "Monthly_Revenue Avg_Customer_Satisfaction",
)
query(
    "exec_revenue_health",
    "SELECT sum(Monthly_Bill) AS Total_Monthly_Revenue, count(*) FILTER (WHERE Bill_Category = 'High')"
    " AS High_Value_Customers, sum(Monthly_Bill) * 12 AS Annual_Revenue_Projection FROM gold_billing",
    "Total_Monthly_Revenue Annual_Revenue_Projection",
)
query(
    "exec_risk",
    "SELECT count(*) FILTER (WHERE Calculated_Churn_Risk = 'High') AS High_Churn_Risk,"
    " count(*) FILTER (WHERE Payment_Status IS DISTINCT FROM 'Paid') AS Payment_Issues,"
    " count(*) FILTER (WHERE Contract_Renewal_Risk = 'Expiring Soon') AS Contracts_Expiring_Soon FROM gold_billing",
)
query(
    "exec_performance",
    "SELECT * FROM (SELECT count(*) FILTER (WHERE Performance_Tier = 'Expert') AS Expert_Technicians,"
    " avg(Resolution_Time_Hrs) AS Avg_Resolution_Time FROM gold_operations),"
    " (SELECT count(*) FILTER (WHERE Popularity_Tier = 'Viral') AS Viral_Content FROM gold_content)",
    "Avg_Resolution_Time",
)
query(
    "exec_revenue_at_risk",
    "SELECT Calculated_Churn_Risk, sum(Monthly_Bill) AS Monthly_Bill FROM gold_billing GROUP BY 1",
    "Monthly_Bill",
)
query(
    "exec_engagement_vs_rating",
    "SELECT 'Engagement Score' AS Metric, avg(Engagement_Score) AS Score FROM gold_content"
    " UNION ALL SELECT 'User Rating', avg(Avg_User_Rating) * 20 FROM gold_content",
    "Score",
)
query(
    "layer_reconciliation",
    union(
        [
            f"""SELECT '{layer}' AS Layer, 'rows' AS Item, count(*) AS "Count" FROM {table}
 UNION ALL SELECT '{layer}', 'genres', count(DISTINCT Program_Genre) FROM {table}
 UNION ALL SELECT '{layer}', 'genre ' || Program_Genre, count(*) FROM {table} WHERE Program_Genre IS NOT NULL
 GROUP BY Program_Genre"""
            for layer, table in (("bronze", "bronze_logs"), ("gold", "gold_content"))
        ]
    ),
)



# KPI cards
def cards(row: str, texts: dict[str, str]) -> str:
    return union([f"SELECT '{title}' AS Card, {text} AS Text FROM ({row})" for title, text in texts.items()])


def money(column: str, digits: int = 0) -> str:
    return f"format('${{:,.{digits}f}}', {column})"


def whole(column: str) -> str:
    return f"format('{{:,.0f}}', CAST({column} AS DOUBLE))"


def rating(column: str) -> str:
    return f"format('{{:.2f}}/5.0', {column})"


query(
    "d1_kpi_cards",
    cards(
        "SELECT sum(Monthly_Bill) AS bills, avg(Monthly_Bill) AS bill, count(*) AS n, avg(Service_Health_Score) AS health,"
        " count(*) FILTER (WHERE Payment_Status = 'Paid') AS paid, avg(Customer_Lifetime_Value) AS ltv,"
        " count(*) FILTER (WHERE Calculated_Churn_Risk = 'High') AS churn FROM gold_billing",
        {
            "Total Monthly Revenue": money("bills"),
            "Annual Revenue (Projected)": money("bills * 12"),
            "Active Customers": whole("n"),
            "Avg Monthly Bill": money("bill", 2),
            "Avg Health Score (0-100)": "format('{:.1f}', health)",
            "Customers in Good Standing": whole("paid"),
            "High Churn Risk Count": whole("churn"),
            "Avg Customer LTV": money("ltv"),
        },
    ),
)
query(
    "d2_kpi_cards",
    cards(
        content_kpis("gold_content"),
        {
            "Total Views": whole("Total_Views"),
            "Total Engagement Hours": whole("Total_Engagement_Hours"),
            "Avg Unique Viewers": whole("Avg_Unique_Viewers"),
            "Avg User Rating": rating("Avg_User_Rating"),
        },
    ),
)
query(
    "d3_kpi_cards",
    cards(
        "SELECT count(*) AS n, avg(Resolution_Time_Hrs) AS hours, avg(Customer_Satisfaction_Rating) AS rated,"
        " count(*) FILTER (WHERE Performance_Tier = 'Expert') AS experts FROM gold_operations",
        {
            "Total Service Tickets": whole("n"),
            "Avg Resolution Time (hrs)": "format('{:.1f}', hours)",
            "Expert Technicians": whole("experts"),
            "Avg Satisfaction Rating": rating("rated"),
        },
    ),
)
query(
    "exec_kpi_cards",
    cards(
        "SELECT * FROM (SELECT count(*) AS n, sum(Monthly_Bill) AS bills FROM gold_billing),"
        " (SELECT avg(Customer_Satisfaction_Rating) AS rated FROM gold_operations),"
        " (SELECT sum(Total_Views) AS views FROM gold_content)",
        {
            "Total Customers": whole("n"),
            "Monthly Revenue": money("bills"),
            "Avg Customer Satisfaction": rating("rated"),
            "Total Content Views": whole("views"),
        },
    ),
)

# data quality
_columns = {
    "bronze_customers": """Customer_ID Name Email Phone Address City State Zip_Code Subscription_Type Service_Tier
 Monthly_Bill Join_Date Payment_Status Region Contract_End Age_Group Employment_Status Customer_Lifetime_Value
 Loyalty_Points Churn_Risk Number_Of_Devices Has_Outdoor_Dish Auto_Pay_Enabled Paperless_Billing Last_Payment_Date""",
    "bronze_tickets": """Ticket_ID Customer_ID Equipment_Model Issue_Category Priority_Level Signal_Strength_dBm
 Technician_Assigned Department Created_Date Resolved_Date Resolution_Time_Hrs Status Customer_Satisfaction_Rating
 Escalation_Flag First_Contact_Resolution Technician_Expertise_Level Remote_Resolution_Attempted
 On_Site_Visit_Required Cost_Of_Resolution Parts_Replaced""",
    "bronze_logs": """Log_ID Customer_ID Channel_Name Program_Genre Device_Type Network_Type View_Duration_Mins
 Stream_Quality Video_Resolution Buffering_Events Start_Time End_Time Timestamp Content_Type Playback_Speed
 Subtitles_Enabled Closed_Captions_Enabled DVR_Playback Skip_Ads User_Rating Autoplay_Triggered""",
}
_label = {"bronze_customers": "customers", "bronze_tickets": "tickets", "bronze_logs": "viewing_logs"}
query(
    "dq_null_rates",
    union(
        [
            f"SELECT '{_label[table]}' AS Table_Name, '{name}' AS Column_Name,"
            f" avg({flag(name + ' IS NULL')}) AS Null_Rate FROM {table}"
            for table, names in _columns.items()
            for name in names.split()
        ]
    ),
    "Null_Rate",
)
query(
    "dq_duplicate_customers",
    "SELECT Customer_ID, count(*) AS Copies,"
    " count(DISTINCT Name) + max(CAST(Name IS NULL AS INTEGER)) > 1 AS Names_Differ,"
    " count(DISTINCT Monthly_Bill) + max(CAST(Monthly_Bill IS NULL AS INTEGER)) > 1 AS Bills_Differ"
    " FROM bronze_customers GROUP BY Customer_ID HAVING count(*) > 1",
)
query(
    "dq_future_dates",
    f"SELECT count(*) AS Row_Count, count(*) FILTER (WHERE Join_Date > {AS_OF}) AS Future_Join_Dates FROM bronze_customers",
)
query(
    "dq_outliers",
    "SELECT 'customers' AS Table_Name, 'Monthly_Bill' AS Column_Name, count(*) FILTER (WHERE Monthly_Bill > 1000)"
    " AS Outliers, max(Monthly_Bill) AS Largest FROM bronze_customers UNION ALL"
    " SELECT 'viewing_logs', 'View_Duration_Mins', count(*) FILTER (WHERE View_Duration_Mins > 480),"
    " CAST(max(View_Duration_Mins) AS DOUBLE) FROM bronze_logs",
    "Largest",
)
_variants = {
    "bronze_customers": ["Subscription_Type", "Service_Tier", "Employment_Status", "State"],
    "bronze_tickets": ["Status", "Equipment_Model", "Issue_Category", "Department"],
    "bronze_logs": ["Stream_Quality", "Video_Resolution", "Content_Type"],
}
query(
    "dq_category_variants",
    union(
        [
            f"SELECT '{_label[table]}' AS Table_Name, '{name}' AS Column_Name, count(DISTINCT {name}) AS Spellings,"
            f" count(DISTINCT lower({name})) AS Categories FROM {table}"
            for table, names in _variants.items()
            for name in names
        ]
    ),
)


def spelling(columns: dict[str, list[str]]) -> str:
    """Spellings and their classes: here every pair of skeletons is compared, and classes are walked."""
    values = " UNION ALL ".join(
        f"SELECT '{_label.get(table, 'tickets')}' AS Table_Name, '{name}' AS Column_Name, {name} AS Value, count(*) AS Row_Count"
        f" FROM {table} WHERE {name} IS NOT NULL GROUP BY 3"
        for table, names in columns.items()
        for name in names
    )
    return f"""
    WITH RECURSIVE counted AS ({values}),
    bare AS (SELECT *, lower(regexp_replace(Value, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS folded FROM counted),
    boned AS (SELECT *, string_split(folded[1:1] || regexp_replace(folded[2:], '[aeiou]', '', 'g'), '') AS letters FROM bare),
    skeletons AS (
      SELECT *, array_to_string(list_filter(letters, lambda x, i: i = 1 OR x <> letters[i - 1] OR NOT regexp_matches(x, '\\p{{L}}')), '') AS bone
      FROM boned),
    spelled AS (
      SELECT *, CASE WHEN folded = '' THEN '=' || Value WHEN len(bone) < 4 THEN '~' || folded ELSE bone END AS skeleton FROM skeletons),
    longest AS (
      SELECT Table_Name, Column_Name, skeleton, arg_max(folded, (len(folded), folded)) AS folded
      FROM spelled WHERE skeleton = bone GROUP BY ALL),
    links AS (
      SELECT a.Table_Name, a.Column_Name, a.skeleton AS a, b.skeleton AS b
      FROM longest a JOIN longest b ON a.Table_Name = b.Table_Name AND a.Column_Name = b.Column_Name AND a.skeleton <> b.skeleton
      WHERE levenshtein(a.skeleton, b.skeleton) <= 1
        AND levenshtein(a.folded, b.folded) <= floor(greatest(len(a.folded), len(b.folded)) * 0.25)
        AND regexp_replace(a.folded, '[^\\p{{N}}]', '', 'g') = regexp_replace(b.folded, '[^\\p{{N}}]', '', 'g')),
    reach AS (
      SELECT DISTINCT Table_Name, Column_Name, skeleton, skeleton AS other FROM spelled
      UNION
      SELECT r.Table_Name, r.Column_Name, r.skeleton, l.b FROM reach r
      JOIN links l ON r.Table_Name = l.Table_Name AND r.Column_Name = l.Column_Name AND r.other = l.a),
    classes AS (SELECT Table_Name, Column_Name, skeleton, min(other) AS class FROM reach GROUP BY ALL)
    SELECT Table_Name, Column_Name, Value, Row_Count,
      first_value(Value) OVER (PARTITION BY Table_Name, Column_Name, class ORDER BY Row_Count DESC, Value) AS Class_Name,
      count(*) OVER (PARTITION BY Table_Name, Column_Name, class) AS Class_Spellings,
      CAST(sum(Row_Count) OVER (PARTITION BY Table_Name, Column_Name, class) AS BIGINT) AS Class_Rows
    FROM spelled JOIN classes USING (Table_Name, Column_Name, skeleton)"""


query("dq_spelling_clusters", f"SELECT * FROM ({spelling({name.replace('bronze_t', 'misspelled_t'): names for name, names in _variants.items()})})")
_spelled = spelling({"misspelled_tickets": ["Status", "Department"]})
query(
    "unified_tickets",
    f"SELECT coalesce(s.Class_Name, Status) AS Status, coalesce(d.Class_Name, Department) AS Department, count(*) AS Tickets"
    f" FROM misspelled_tickets LEFT JOIN (SELECT * FROM ({_spelled}) WHERE Column_Name = 'Status') s ON Status = s.Value"
    f" LEFT JOIN (SELECT * FROM ({_spelled}) WHERE Column_Name = 'Department') d ON Department = d.Value GROUP BY 1, 2",
)
ORACLES["incremental_silver"] = ORACLES["layer_silver"]
_by_region = "Region, count(*) AS Row_Count FROM bronze_customers WHERE {} GROUP BY Region"
query(
    "layer_reload",
    union(
        [
            f"SELECT '{step}' AS Step, {_by_region.format(kept)}"
            for step, kept in {
                "first load": "Region <> 'ASIA'", "before expiry": "Region <> 'ASIA'", "after expiry": "true",
                "before clear": "true", "after clear": "Region = 'ASIA'",
            }.items()
        ]
    ),
)
_full_cell = " AND ".join(f"{key} IS NOT NULL" for key in KEYS.split(", "))
query(
    "d2_distinct_viewers",
    union(
        [
            f"SELECT '{label}' AS Dimension, {key} AS \"Key\", count(Log_ID) AS Total_Views,"
            f" count(DISTINCT Customer_ID) AS Distinct_Viewers, true AS Within_Bound FROM silver_logs WHERE {_full_cell}{extra} GROUP BY {key}"
            for label, key, extra in [
                *[(key, key, "") for key in KEYS.split(", ")],
                ("Program_Genre on two devices", "Program_Genre", " AND Device_Type IN ('Smart Tv', 'Tablet')"),
            ]
        ]
    ),
)
query(
    "dq_negative_durations",
    "SELECT 'tickets' AS Table_Name, count(*) AS Row_Count, count(*) FILTER (WHERE Resolved_Date < Created_Date)"
    " AS Negative_Durations FROM bronze_tickets UNION ALL"
    " SELECT 'viewing_logs', count(*), count(*) FILTER (WHERE End_Time < Start_Time) FROM bronze_logs",
)
query(
    "dq_orphans",
    union(
        [
            f"SELECT '{_label[table]}' AS Table_Name, Customer_ID, count(*) AS Orphan_Rows FROM {table} f"
            " WHERE NOT EXISTS (SELECT 1 FROM bronze_customers c WHERE c.Customer_ID = f.Customer_ID) GROUP BY 2"
            for table in ("bronze_tickets", "bronze_logs")
        ]
    ),
)


def panel(name: str, key: str, table: str, **measures: str) -> str:
    """One panel of a page in long form; ``key`` NULL: of the whole table."""
    where = "" if key == "NULL" else f"WHERE {key} IS NOT NULL GROUP BY {key}"
    return union(
        [
            f"SELECT '{name}' AS Panel, CAST({key} AS VARCHAR) AS Item, '{measure}' AS Measure, CAST({value} AS DOUBLE) AS \"Value\""
            f" FROM {table} {where}"
            for measure, value in measures.items()
        ]
    )


def binned(column: str, bins: int) -> str:
    return f"CAST(greatest(0, least({bins - 1}, floor({column} / (100e0 / {bins})))) AS INTEGER)"


ROWS, BILLS, VIEWS = {"Count": "count(*)"}, {"Revenue": "sum(Monthly_Bill)"}, {"Total_Views": "sum(Total_Views)"}
query(
    "d1_page",
    union(
        [
            panel(
                "total", "NULL", "gold_billing", Total_Monthly_Revenue="sum(Monthly_Bill)", Annual_Revenue="sum(Monthly_Bill) * 12",
                Active_Customers="count(*)", Avg_Monthly_Bill="avg(Monthly_Bill)", Avg_Health_Score="avg(Service_Health_Score)",
                Customers_In_Good_Standing="count(*) FILTER (WHERE Payment_Status = 'Paid')",
                High_Churn_Risk_Count="count(*) FILTER (WHERE Calculated_Churn_Risk = 'High')", Avg_Customer_LTV="avg(Customer_Lifetime_Value)",
            ),
            panel("region", "Region", "gold_billing", Customer_Count="count(Customer_ID)", **BILLS),
            panel("bill_category", "Bill_Category", "gold_billing", **ROWS, **BILLS),
            panel("churn", "Calculated_Churn_Risk", "gold_billing", **ROWS),
            panel("payment", "Payment_Status", "gold_billing", **ROWS),
            panel("contract", "Contract_Renewal_Risk", "gold_billing", **ROWS),
            panel("segment", "Customer_Segment", "gold_billing", **ROWS, **BILLS),
            panel("health_bins", binned("Service_Health_Score", 20), "gold_billing", **ROWS),
            panel("device_bins", binned("Device_Adoption_Score", 15), "gold_billing", **ROWS),
        ]
    ),
    '"Value"',
)
query(
    "d2_page",
    union(
        [
            panel(
                "total", "NULL", "gold_content", Total_Engagement_Hours="sum(Total_Engagement_Hours)",
                Avg_Unique_Viewers="avg(Unique_Customer_Count)", Avg_User_Rating="avg(Avg_User_Rating)", **VIEWS,
            ),
            panel("genre", "Program_Genre", "gold_content", Total_View_Duration_Mins="sum(Total_View_Duration_Mins)", **VIEWS),
            panel("device", "Device_Type", "gold_content", Unique_Customer_Count="sum(Unique_Customer_Count)", **VIEWS),
            panel("quality", "Quality_Satisfaction", "gold_content", **ROWS),
            panel("popularity", "Popularity_Tier", "gold_content", **ROWS),
            panel("health", "Content_Health", "gold_content", **ROWS),
            panel("engagement_bins", binned("Engagement_Score", 15), "gold_content", **ROWS),
        ]
    ),
    '"Value"',
)
query(
    "d3_page",
    union(
        [
            panel(
                "total", "NULL", "gold_operations", Total_Service_Tickets="count(*)", Avg_Resolution_Time="avg(Resolution_Time_Hrs)",
                Expert_Technicians="count(*) FILTER (WHERE Performance_Tier = 'Expert')",
                Avg_Satisfaction_Rating="avg(Customer_Satisfaction_Rating)",
            ),
            panel("efficiency", "Resolution_Efficiency", "gold_operations", **ROWS),
            panel("tier", "Performance_Tier", "gold_operations", **ROWS),
            panel("equipment", "Equipment_Model", "gold_operations", Reliability_Index="avg(Reliability_Index)", **ROWS),
            panel("issue", "Issue_Category", "gold_operations", **ROWS),
            panel("signal", "Signal_Quality", "gold_operations", **ROWS),
            panel("score_bins", binned("Overall_Performance_Score", 20), "gold_operations", **ROWS),
            panel("impact_bins", binned("Issue_Impact_Score", 15), "gold_operations", **ROWS),
        ]
    ),
    '"Value"',
)

D3_NULL = "(SELECT * FROM gold_operations WHERE Department = 'Billing' OR Department IS NULL)"
query("gold_chosen", contents([("billing_segmentation", D1), ("content_strategy", D2), ("network_operations", D3_NULL)]))
