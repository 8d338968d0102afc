"""Common table expressions: bronze, silver and gold as DuckDB SQL."""

import re


def title(column: str) -> str:
    words = f"regexp_extract_all({column}, '[A-Za-z]+|[^A-Za-z]+')"
    joined = f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), '')"
    return f"CASE WHEN {column} IS NOT NULL THEN {joined} END"


def clip(x: str, low: str = "0e0", high: str = "100e0") -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, CAST(({x}) AS DOUBLE))) END"


def score(x: str) -> str:
    return f"coalesce(CAST(trunc({x}) AS INTEGER), 0)"


def flag(column: str) -> str:
    return f"CAST({column} AS INTEGER)"


AS_OF = "DATE '2026-03-13'"

CTES = {}

CTES["bronze_customers"] = f"""
SELECT c_custkey AS Customer_ID,
  CASE WHEN copy = 1 THEN 'dup ' ELSE '' END || lower(c_name) AS Name,
  'user' || c_custkey || '@mail.test' AS Email,
  CASE WHEN c_custkey % 50 = 9 THEN NULL ELSE 'ph' || c_custkey END AS Phone,
  c_custkey || ' main st, unit "' || (c_custkey % 100) || '"' AS Address,
  n_name AS City, lower(n_name) AS State,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS Zip_Code,
  CASE c_custkey % 7 WHEN 0 THEN 'family''s top 120' WHEN 1 THEN 'FAMILY''S TOP 250'
    WHEN 2 THEN 'orange saver' ELSE 'Spanish Premium' END AS Subscription_Type,
  c_mktsegment AS Service_Tier,
  CASE WHEN copy = 1 AND c_custkey % 100 = 0 THEN bill + 1 ELSE bill END AS Monthly_Bill,
  CASE WHEN c_custkey % 120 = 5 THEN DATE '2027-06-01'
    ELSE DATE '2021-03-13' + CAST((c_custkey * 7) % 1826 AS INTEGER) END AS Join_Date,
  CASE (c_custkey // 3) % 4 WHEN 0 THEN 'Paid' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Overdue' ELSE 'Disputed' END
    AS Payment_Status,
  r_name AS Region,
  DATE '2026-03-13' + CAST((c_custkey * 13) % 730 AS INTEGER) AS Contract_End,
  ['18-25', '26-35', '36-45', '46-55', '56-65', '65+'][CAST(c_custkey % 6 + 1 AS INTEGER)] AS Age_Group,
  ['employed', 'SELF-EMPLOYED', 'Retired', 'student', 'Unemployed'][CAST(c_custkey % 5 + 1 AS INTEGER)]
    AS Employment_Status,
  abs(c_acctbal) * 1.45e0 + 500e0 AS Customer_Lifetime_Value,
  (c_custkey * 37) % 50001 AS Loyalty_Points,
  ['Low', 'Medium', 'High'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS Churn_Risk,
  CAST(c_custkey % 8 + 1 AS INTEGER) AS Number_Of_Devices,
  c_custkey % 2 = 0 AS Has_Outdoor_Dish, c_custkey % 3 = 0 AS Auto_Pay_Enabled,
  c_custkey % 4 = 0 AS Paperless_Billing,
  DATE '2026-03-13' - CAST((c_custkey * 11) % 90 AS INTEGER) AS Last_Payment_Date,
  c_custkey * 2 + copy AS ingest_seq
FROM (
  SELECT *, CASE WHEN c_custkey % 20 = 7 THEN NULL
      WHEN c_custkey % 240 = 3 THEN (500000 + cents // 5) / 100e0
      ELSE (5000 + cents // 50) / 100e0 END AS bill
  FROM (
    SELECT customer.*, n_name, r_name, copy, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    CROSS JOIN (VALUES (0), (1)) copies(copy)
    WHERE copy = 0 OR c_custkey % 50 = 0))
"""

CTES["bronze_tickets"] = """
SELECT o_orderkey AS Ticket_ID,
  CASE WHEN o_orderkey % 211 = 5 THEN -o_custkey ELSE o_custkey END AS Customer_ID,
  CASE o_orderkey % 7 WHEN 0 THEN 'gateway 3' WHEN 1 THEN 'MINI' WHEN 2 THEN 'relay' WHEN 3 THEN '4K Mini'
    ELSE 'Outdoor Antenna' END AS Equipment_Model,
  CASE o_custkey % 4 WHEN 0 THEN 'signal loss' WHEN 1 THEN 'HARDWARE failure' WHEN 2 THEN 'Billing'
    ELSE 'remote pairing' END AS Issue_Category,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium'
    ELSE 'Low' END AS Priority_Level,
  CASE WHEN o_orderkey % 20 = 11 THEN NULL ELSE CAST(-30 - (o_orderkey * 17) % 71 AS DOUBLE) END
    AS Signal_Strength_dBm,
  CASE WHEN o_orderkey % 50 = 13 THEN NULL ELSE 'tech ' || person END AS Technician_Assigned,
  CASE WHEN o_orderkey % 101 = 7 THEN NULL ELSE
    ['technical SUPPORT', 'billing', 'Installation', 'sales', 'network operations', 'Equipment support'][
      CAST(o_custkey % 6 + 1 AS INTEGER)] END AS Department,
  o_orderdate AS Created_Date,
  o_orderdate + INTERVAL 1 HOUR * CAST((o_orderkey * 29) % 120 - 8 AS INTEGER) AS Resolved_Date,
  CAST(CASE WHEN person < 60 THEN 1 + o_custkey % 6 WHEN person < 120 THEN 1 + o_custkey % 20
    ELSE 1 + (o_custkey * 31) % 80 END AS INTEGER) AS Resolution_Time_Hrs,
  CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'open' ELSE 'In Progress' END AS Status,
  CAST(CASE WHEN o_custkey % 25 = 1 THEN 1.0 WHEN o_orderkey % 33 = 5 THEN NULL
    WHEN person < 60 THEN 4.5 + (o_custkey % 2) * 0.5 WHEN person < 120 THEN 4.0 + (o_custkey % 3) * 0.5
    ELSE 1 + ((o_custkey * 19) % 9) * 0.5 END AS DOUBLE) AS Customer_Satisfaction_Rating,
  o_orderkey % 2 = 0 AS Escalation_Flag,
  person < 60 OR (person < 120 AND o_custkey % 4 <> 0) OR o_custkey % 3 = 0 AS First_Contact_Resolution,
  ['Junior', 'Senior', 'Expert'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS Technician_Expertise_Level,
  o_custkey % 2 = 0 AS Remote_Resolution_Attempted,
  o_custkey % 3 = 1 AS On_Site_Visit_Required,
  CAST(CASE WHEN person < 60 THEN o_custkey % 20 WHEN person < 120 THEN o_custkey % 150
    ELSE (o_custkey * 23) % 500 END AS DOUBLE) AS Cost_Of_Resolution,
  o_orderkey % 4 = 0 AS Parts_Replaced
FROM (
  SELECT * REPLACE (CASE WHEN o_custkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey),
    (o_orderkey * 7) % 300 AS person
  FROM orders)
"""

CTES["bronze_logs"] = """
SELECT event_id AS Log_ID,
  CASE WHEN event_id % 307 = 11 THEN -user_id ELSE user_id END AS Customer_ID,
  'ch ' || CASE WHEN event_type = 'error' THEN k % 20 ELSE k % 8 END AS Channel_Name,
  event_type AS Program_Genre,
  ['Smart TV', 'Set-top Box', 'Tablet'][CAST(user_id % 3 + 1 AS INTEGER)] AS Device_Type,
  ['Home WiFi', 'Mobile Network', 'Guest WiFi', 'Cellular'][CAST(event_id % 4 + 1 AS INTEGER)] AS Network_Type,
  minutes AS View_Duration_Mins,
  CASE WHEN event_id % 6 < 3 THEN 'hd' WHEN event_id % 6 < 5 THEN '4k' ELSE 'sd' END AS Stream_Quality,
  ['1080p', '720P', '480p', '2160p'][CAST(event_id % 4 + 1 AS INTEGER)] AS Video_Resolution,
  CAST(CASE WHEN event_id % 33 = 4 THEN NULL WHEN user_id % 3 = 2 AND k % 4 = 0 THEN 0
    WHEN user_id % 3 = 2 THEN event_id % 5 ELSE event_id % 16 END AS DOUBLE) AS Buffering_Events,
  ts AS Start_Time,
  ts + INTERVAL 1 MINUTE * (CASE WHEN event_id % 89 = 0 THEN -30 ELSE minutes END) AS End_Time,
  ts AS Timestamp,
  ['live', 'On-demand', 'RECORDED'][CAST(event_id % 3 + 1 AS INTEGER)] AS Content_Type,
  ['1x', '1.5x', '2x', '0.5x'][CAST(event_id % 4 + 1 AS INTEGER)] AS Playback_Speed,
  event_id % 2 = 0 AS Subtitles_Enabled, event_id % 3 = 0 AS Closed_Captions_Enabled,
  event_id % 4 = 0 AS DVR_Playback, event_id % 5 = 0 AS Skip_Ads,
  CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_id % 6 = 5 THEN NULL ELSE (event_id * 3) % 5 + 1 END
    AS DOUBLE) AS User_Rating,
  event_id % 7 = 0 AS Autoplay_Triggered
FROM (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(CASE WHEN event_id % 97 = 0 THEN 5000 WHEN event_type = 'error' THEN 5 + floor("value" / 8)
      ELSE 5 + floor("value") END AS INTEGER) AS minutes
  FROM events)
"""

CTES["misspelled_tickets"] = """
SELECT * REPLACE (
  CASE WHEN Status = 'CLOSED' AND Ticket_ID % 37 = 3 THEN 'Clsd' WHEN Status = 'CLOSED' AND Ticket_ID % 41 = 5 THEN ' closed.'
    WHEN Status = 'In Progress' AND Ticket_ID % 43 = 7 THEN 'in-Progres' ELSE Status END AS Status,
  CASE WHEN Department = 'billing' AND Ticket_ID % 31 = 2 THEN 'Biling'
    WHEN Department = 'Installation' AND Ticket_ID % 29 = 4 THEN 'Instalation'
    WHEN Department = 'network operations' AND Ticket_ID % 23 = 9 THEN 'Netwark Operations' ELSE Department END AS Department)
FROM bronze_tickets
"""

CTES["silver_customers"] = f"""
SELECT * EXCLUDE (ingest_seq) REPLACE (
  {title('Name')} AS Name, {title('City')} AS City, upper(State) AS State,
  {title('Subscription_Type')} AS Subscription_Type, {title('Service_Tier')} AS Service_Tier,
  {title('Employment_Status')} AS Employment_Status,
  coalesce(Phone, 'Unknown') AS Phone,
  coalesce(Monthly_Bill, (SELECT quantile_cont(Monthly_Bill, 0.5) FROM bronze_customers)) AS Monthly_Bill,
  CASE WHEN Join_Date > {AS_OF} THEN {AS_OF} ELSE Join_Date END AS Join_Date)
FROM bronze_customers
QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY ingest_seq) = 1
"""

CTES["silver_tickets"] = f"""
SELECT * REPLACE (
  {title('Status')} AS Status, {title('Equipment_Model')} AS Equipment_Model,
  {title('Issue_Category')} AS Issue_Category, {title('Department')} AS Department,
  coalesce({title('Technician_Assigned')}, 'Unassigned') AS Technician_Assigned,
  coalesce(Signal_Strength_dBm, (SELECT CAST(sum(CAST(Signal_Strength_dBm AS DECIMAL(28, 6))) AS DOUBLE) / count(Signal_Strength_dBm) FROM bronze_tickets)) AS Signal_Strength_dBm,
  coalesce(Customer_Satisfaction_Rating, (SELECT quantile_cont(Customer_Satisfaction_Rating, 0.5) FROM bronze_tickets))
    AS Customer_Satisfaction_Rating)
FROM bronze_tickets
"""

CTES["silver_logs"] = f"""
SELECT * REPLACE (
  {title('Device_Type')} AS Device_Type, {title('Channel_Name')} AS Channel_Name,
  {title('Program_Genre')} AS Program_Genre, {title('Content_Type')} AS Content_Type,
  upper(Stream_Quality) AS Stream_Quality, upper(Video_Resolution) AS Video_Resolution,
  CASE WHEN View_Duration_Mins > 480 THEN 480 ELSE View_Duration_Mins END AS View_Duration_Mins,
  coalesce(Buffering_Events, (SELECT CAST(sum(CAST(Buffering_Events AS DECIMAL(28, 6))) AS DOUBLE) / count(Buffering_Events) FROM bronze_logs)) AS Buffering_Events,
  coalesce(User_Rating, (SELECT quantile_cont(User_Rating, 0.5) FROM bronze_logs)) AS User_Rating)
FROM bronze_logs
"""

CTES["ticket_metrics"] = """
SELECT Customer_ID, count(Ticket_ID) AS Total_Tickets,
  coalesce(avg(Resolution_Time_Hrs), 0) AS Avg_Resolution_Time,
  coalesce(CAST(sum(CAST(Escalation_Flag AS INTEGER)) AS BIGINT), 0) AS Critical_Escalations,
  coalesce(CAST(sum(CAST(Customer_Satisfaction_Rating AS DECIMAL(28, 6))) AS DOUBLE) / count(Customer_Satisfaction_Rating), 0) AS Avg_Satisfaction,
  coalesce(avg(CAST(First_Contact_Resolution AS INTEGER)), 0) AS FCR_Rate,
  coalesce(CAST(sum(CAST(Signal_Strength_dBm AS DECIMAL(28, 6))) AS DOUBLE) / count(Signal_Strength_dBm), 0) AS Avg_Signal_Strength
FROM silver_tickets WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID
"""

CTES["joined_customers"] = """
SELECT c.* REPLACE (
    coalesce(Monthly_Bill, 0) AS Monthly_Bill, coalesce(Customer_Lifetime_Value, 0) AS Customer_Lifetime_Value,
    coalesce(Loyalty_Points, 0) AS Loyalty_Points, coalesce(Number_Of_Devices, 0) AS Number_Of_Devices),
  coalesce(Total_Tickets, 0) AS Total_Tickets, coalesce(Avg_Resolution_Time, 0) AS Avg_Resolution_Time,
  coalesce(Critical_Escalations, 0) AS Critical_Escalations, coalesce(Avg_Satisfaction, 0) AS Avg_Satisfaction,
  coalesce(FCR_Rate, 0) AS FCR_Rate, coalesce(Avg_Signal_Strength, 0) AS Avg_Signal_Strength
FROM silver_customers c LEFT JOIN ticket_metrics m USING (Customer_ID)
"""

_health = score(
    f"({clip('100 - Avg_Signal_Strength')}) * 0.3e0 + ({clip('100 - Total_Tickets * 10')}) * 0.3e0"
    f" + ({clip('Avg_Satisfaction * 20')}) * 0.4e0"
)
_ltv = score(clip("(Customer_Lifetime_Value - low) / nullif(high - low, 0) * 100"))
_points = clip("Loyalty_Points / nullif(most, 0) * 60", "0e0", "60e0")
_loyalty = score(clip(f"Customer_Tenure_Years / 5 * 40 + {_points}"))

CTES["customer_kpis"] = f"""
SELECT *,
  {score("CASE Payment_Status WHEN 'Overdue' THEN " + clip('Payment_Days_Overdue * 2')
         + " WHEN 'Pending' THEN 30 WHEN 'Disputed' THEN 50 ELSE 10 END")} AS Payment_Risk_Score,
  CASE WHEN Service_Health_Score < 40 THEN 'High' WHEN Service_Health_Score < 70 THEN 'Medium' ELSE 'Low' END
    AS Calculated_Churn_Risk,
  CASE WHEN Days_Until_Contract_End < 30 THEN 'Expiring Soon' WHEN Days_Until_Contract_End < 90 THEN 'At Risk'
    ELSE 'Stable' END AS Contract_Renewal_Risk,
  {_loyalty} AS Loyalty_Index,
  CASE WHEN Service_Health_Score >= 80 THEN 'VIP_Advocates'
    WHEN Service_Health_Score >= 60 AND LTV_Index >= 50 THEN 'Growth_Opportunity'
    WHEN Service_Health_Score < 40 THEN 'At_Risk_High_Value' ELSE 'Standard' END AS Customer_Segment
FROM (
  SELECT j.*, most,
    date_diff('day', Join_Date, {AS_OF}) / 365.25e0 AS Customer_Tenure_Years,
    CASE WHEN Monthly_Bill >= 0 AND Monthly_Bill < 80 THEN 'Low'
      WHEN Monthly_Bill >= 80 AND Monthly_Bill < 150 THEN 'Medium' WHEN Monthly_Bill >= 150 THEN 'High' END
      AS Bill_Category,
    Monthly_Bill * 12 AS Monthly_Revenue,
    {_health} AS Service_Health_Score,
    CAST(date_diff('day', Last_Payment_Date, {AS_OF}) AS INTEGER) AS Payment_Days_Overdue,
    {_ltv} AS LTV_Index,
    {score(clip('Number_Of_Devices / 8e0 * 100'))} AS Device_Adoption_Score,
    CAST(date_diff('day', {AS_OF}, Contract_End) AS INTEGER) AS Days_Until_Contract_End,
    CASE WHEN Monthly_Bill < 100 THEN 'Undermonetized' WHEN Monthly_Bill < 180 THEN 'Optimal' ELSE 'Premium' END
      AS Revenue_Health
  FROM joined_customers j CROSS JOIN (
    SELECT min(Customer_Lifetime_Value) AS low, max(Customer_Lifetime_Value) AS high, max(Loyalty_Points) AS most
    FROM joined_customers))
"""

CTES["gold_billing"] = """
SELECT Customer_ID, Name, City, State, Region, Email, Subscription_Type, Service_Tier, Monthly_Bill, Monthly_Revenue,
  Bill_Category, Payment_Status, Payment_Risk_Score, Payment_Days_Overdue, Customer_Tenure_Years, Join_Date,
  Contract_Renewal_Risk, Auto_Pay_Enabled, Paperless_Billing, Total_Tickets, Avg_Resolution_Time,
  Critical_Escalations, Avg_Satisfaction, FCR_Rate, Avg_Signal_Strength, Service_Health_Score, Churn_Risk,
  Calculated_Churn_Risk, Customer_Lifetime_Value, LTV_Index, Loyalty_Points, Loyalty_Index, Number_Of_Devices,
  Device_Adoption_Score, Age_Group, Employment_Status, Revenue_Health, Customer_Segment
FROM customer_kpis
"""

CTES["technician_stats"] = """
SELECT Technician_Assigned, count(Ticket_ID) AS Tickets_Count,
  coalesce(avg(Resolution_Time_Hrs), 0) AS Avg_Resolution_Time,
  coalesce(CAST(sum(CAST(Customer_Satisfaction_Rating AS DECIMAL(28, 6))) AS DOUBLE) / count(Customer_Satisfaction_Rating), 0) AS Avg_Satisfaction,
  coalesce(avg(CAST(First_Contact_Resolution AS INTEGER)), 0) AS FCR_Rate,
  coalesce(avg(CAST(Remote_Resolution_Attempted AS INTEGER)), 0) AS Remote_Resolution_Rate,
  coalesce(CAST(sum(CAST(Cost_Of_Resolution AS DECIMAL(28, 6))) AS DOUBLE) / count(Cost_Of_Resolution), 0) AS Cost_Per_Ticket
FROM silver_tickets WHERE Technician_Assigned IS NOT NULL GROUP BY Technician_Assigned
"""

CTES["bare_technician_stats"] = """
SELECT Technician_Assigned, count(Ticket_ID) AS Tickets_Count,
  coalesce(avg(Resolution_Time_Hrs), 0) AS Avg_Resolution_Time, 4e0 AS Avg_Satisfaction, 0.7e0 AS FCR_Rate,
  0.5e0 AS Remote_Resolution_Rate, 150 AS Cost_Per_Ticket
FROM silver_tickets WHERE Technician_Assigned IS NOT NULL GROUP BY Technician_Assigned
"""


def scored_technicians(stats: str) -> str:
    speed = score(clip("100 - Avg_Resolution_Time / nullif(slowest, 0) * 100"))
    cost = score(clip("100 - Cost_Per_Ticket / nullif(CAST(dearest AS DOUBLE), 0) * 100"))
    overall = score(
        "Speed_Score * 0.25e0 + Satisfaction_Score * 0.35e0 + FCR_Score * 0.25e0 + Cost_Efficiency_Score * 0.15e0"
    )
    return f"""
SELECT *, CASE WHEN Overall_Performance_Score >= 85 THEN 'Expert' WHEN Overall_Performance_Score >= 70
    THEN 'Proficient' ELSE 'Developing' END AS Performance_Tier
FROM (
  SELECT *, {overall} AS Overall_Performance_Score
  FROM (
    SELECT t.*, {speed} AS Speed_Score, {score(clip('Avg_Satisfaction / 5 * 100'))} AS Satisfaction_Score,
      {score(clip('FCR_Rate * 100'))} AS FCR_Score, {cost} AS Cost_Efficiency_Score
    FROM {stats} t CROSS JOIN (
      SELECT max(Avg_Resolution_Time) AS slowest, max(Cost_Per_Ticket) AS dearest FROM {stats})))
"""


CTES["technician_scores"] = scored_technicians("technician_stats")
CTES["bare_technician_scores"] = scored_technicians("bare_technician_stats")

CTES["equipment_stats"] = """
SELECT Equipment_Model, count(Ticket_ID) AS Total_Issues,
  coalesce(avg(Resolution_Time_Hrs), 0) AS Avg_Resolution_Time,
  count(*) FILTER (WHERE Priority_Level = 'High') / CAST(count(*) AS DOUBLE) AS High_Priority_Rate,
  coalesce(avg(CAST(Escalation_Flag AS INTEGER)), 0) AS Escalation_Rate
FROM silver_tickets WHERE Equipment_Model IS NOT NULL GROUP BY Equipment_Model
"""

_reliability = score(clip("100 - Total_Issues / nullif(CAST(most AS DOUBLE), 0) * 40 - Escalation_Rate * 60"))
CTES["equipment_reliability"] = f"""
SELECT e.*, {_reliability} AS Reliability_Index
FROM equipment_stats e CROSS JOIN (SELECT max(Total_Issues) AS most FROM equipment_stats)
"""

CTES["department_stats"] = """
SELECT Department, count(Ticket_ID) AS Tickets_Handled, coalesce(avg(Resolution_Time_Hrs), 0) AS Avg_Resolution,
  coalesce(CAST(sum(CAST(Customer_Satisfaction_Rating AS DECIMAL(28, 6))) AS DOUBLE) / count(Customer_Satisfaction_Rating), 0) AS Satisfaction_Avg
FROM silver_tickets WHERE Department IS NOT NULL GROUP BY Department
"""

_department = score(clip("100 - Avg_Resolution / nullif(slowest, 0) * 100"))
CTES["department_efficiency"] = f"""
SELECT d.*, {_department} AS Dept_Efficiency
FROM department_stats d CROSS JOIN (SELECT max(Avg_Resolution) AS slowest FROM department_stats)
"""

RESOLUTION_BAND = """CASE WHEN Resolution_Time_Hrs > 0 AND Resolution_Time_Hrs <= 4 THEN 'Critical_4h'
    WHEN Resolution_Time_Hrs > 4 AND Resolution_Time_Hrs <= 24 THEN 'High_24h'
    WHEN Resolution_Time_Hrs > 24 AND Resolution_Time_Hrs <= 72 THEN 'Medium_72h'
    WHEN Resolution_Time_Hrs > 72 THEN 'Low_Extended' END"""
SIGNAL_QUALITY = """CASE WHEN Signal_Strength_dBm >= -50 THEN 'Excellent' WHEN Signal_Strength_dBm >= -70 THEN 'Good'
    WHEN Signal_Strength_dBm >= -85 THEN 'Fair' ELSE 'Poor' END"""
EFFICIENCY = """CASE WHEN Resolution_Time_Hrs < (SELECT avg(Resolution_Time_Hrs) FROM silver_tickets) THEN 'High'
    ELSE 'Low' END"""

CTES["gold_operations"] = f"""
SELECT Ticket_ID, Customer_ID, t.Equipment_Model, Issue_Category, Priority_Level, Status, Department,
  t.Technician_Assigned, Overall_Performance_Score, Performance_Tier, Created_Date, Resolution_Time_Hrs,
  {EFFICIENCY} AS Resolution_Efficiency, {RESOLUTION_BAND} AS Issue_Resolution_Time,
  {SIGNAL_QUALITY} AS Signal_Quality, Reliability_Index, Customer_Satisfaction_Rating, Escalation_Flag,
  First_Contact_Resolution, Remote_Resolution_Attempted, Cost_Of_Resolution, 50 AS Issue_Impact_Score
FROM silver_tickets t
LEFT JOIN technician_scores p ON t.Technician_Assigned = p.Technician_Assigned
LEFT JOIN equipment_reliability e ON t.Equipment_Model = e.Equipment_Model
"""

CTES["content_agg"] = """
SELECT Program_Genre, Channel_Name, Device_Type, Stream_Quality,
  coalesce(CAST(sum(View_Duration_Mins) AS BIGINT), 0) AS Total_View_Duration_Mins,
  coalesce(avg(View_Duration_Mins), 0) AS Average_View_Duration_Mins,
  count(DISTINCT Customer_ID) AS Unique_Customer_Count, count(Log_ID) AS Total_Views,
  coalesce(CAST(sum(CAST(Buffering_Events AS DECIMAL(28, 6))) AS DOUBLE) / count(Buffering_Events), 0) AS Avg_Buffering_Events, coalesce(CAST(sum(CAST(User_Rating AS DECIMAL(28, 6))) AS DOUBLE) / count(User_Rating), 0) AS Avg_User_Rating
FROM silver_logs
WHERE Program_Genre IS NOT NULL AND Channel_Name IS NOT NULL AND Device_Type IS NOT NULL
  AND Stream_Quality IS NOT NULL
GROUP BY ALL
"""


def most_common(key: str, name: str) -> str:
    return f"""
(SELECT {key}, Stream_Quality AS {name} FROM (
   SELECT {key}, Stream_Quality, count(*) AS n FROM silver_logs WHERE Stream_Quality IS NOT NULL GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, Stream_Quality) = 1)"""


CTES["genre_performance"] = f"""
SELECT g.*, coalesce(Genre_Peak_Quality, 'HD') AS Genre_Peak_Quality
FROM (
  SELECT Program_Genre, count(DISTINCT Customer_ID) AS Genre_Total_Viewers, count(Log_ID) AS Genre_Total_Views,
    coalesce(avg(View_Duration_Mins), 0) AS Genre_Avg_Duration, coalesce(CAST(sum(CAST(User_Rating AS DECIMAL(28, 6))) AS DOUBLE) / count(User_Rating), 0) AS Genre_Avg_Rating
  FROM silver_logs WHERE Program_Genre IS NOT NULL GROUP BY Program_Genre) g
LEFT JOIN {most_common('Program_Genre', 'Genre_Peak_Quality')} USING (Program_Genre)
"""

CTES["device_performance"] = f"""
SELECT d.*, coalesce(Device_Preferred_Quality, 'HD') AS Device_Preferred_Quality
FROM (
  SELECT Device_Type, count(Log_ID) AS Device_Total_Views, count(DISTINCT Customer_ID) AS Device_Unique_Users,
    coalesce(avg(View_Duration_Mins), 0) AS Device_Avg_Duration,
    coalesce(CAST(sum(CAST(Buffering_Events AS DECIMAL(28, 6))) AS DOUBLE) / count(Buffering_Events), 0) AS Device_Avg_Buffering
  FROM silver_logs WHERE Device_Type IS NOT NULL GROUP BY Device_Type) d
LEFT JOIN {most_common('Device_Type', 'Device_Preferred_Quality')} USING (Device_Type)
"""

CTES["content_type_performance"] = """
SELECT Content_Type, count(Log_ID) AS ContentType_Views, count(DISTINCT Customer_ID) AS ContentType_Unique_Viewers,
  coalesce(avg(View_Duration_Mins), 0) AS ContentType_Avg_Duration
FROM silver_logs WHERE Content_Type IS NOT NULL GROUP BY Content_Type
"""

_strength = score(clip("ln(1 + Genre_Total_Viewers) / nullif(ln(1 + most), 0) * 100"))
CTES["genre_strength"] = f"""
SELECT Program_Genre, Genre_Total_Viewers, Genre_Total_Views, {_strength} AS Genre_Strength_Index
FROM genre_performance CROSS JOIN (SELECT max(Genre_Total_Viewers) AS most FROM genre_performance)
"""

_adoption = score(clip("Device_Total_Views / nullif(CAST(most AS DOUBLE), 0) * 100"))
CTES["device_adoption"] = f"""
SELECT Device_Type, Device_Total_Views, {_adoption} AS Device_Adoption_Index
FROM device_performance CROSS JOIN (SELECT max(Device_Total_Views) AS most FROM device_performance)
"""

_engagement = score(
    clip(
        "ln(1 + Total_Views) / nullif(ln(1 + views), 0) * 40 + Average_View_Duration_Mins / nullif(duration, 0) * 30"
        " + Avg_User_Rating / 5 * 30"
    )
)
_penetration = score("Unique_Customer_Count / nullif(CAST(uniques AS DOUBLE), 0) * 100")
_frequency = score(clip("Total_Views / nullif(CAST(Unique_Customer_Count AS DOUBLE), 0) * 10"))
_opportunity = score(clip("Total_Views / nullif(CAST(views AS DOUBLE), 0) * 100 - Avg_User_Rating / 5 * 20"))

CTES["gold_content"] = f"""
SELECT Program_Genre, Channel_Name, Device_Type, Stream_Quality, Total_View_Duration_Mins, Total_Engagement_Hours,
  Average_View_Duration_Mins, Total_Views, Unique_Customer_Count, Avg_Buffering_Events, Avg_User_Rating,
  CASE WHEN Avg_Buffering_Events > 5 THEN 'Poor' WHEN Avg_Buffering_Events > 2 THEN 'Fair'
    WHEN Avg_Buffering_Events > 0 THEN 'Good' ELSE 'Excellent' END AS Quality_Satisfaction,
  Engagement_Score,
  CASE WHEN Total_Views <= edges[1] THEN 'Low' WHEN Total_Views <= edges[2] THEN 'Medium'
    WHEN Total_Views <= edges[3] THEN 'High' ELSE 'Viral' END AS Popularity_Tier,
  Customer_Penetration, Genre_Strength_Index, Device_Adoption_Index,
  CASE WHEN Engagement_Score >= 75 THEN 'Excellent' WHEN Engagement_Score >= 50 THEN 'Healthy'
    WHEN Engagement_Score >= 25 THEN 'At_Risk' ELSE 'Critical' END AS Content_Health,
  Viewing_Frequency,
  {score(clip('Customer_Penetration * 0.6e0 + Viewing_Frequency * 0.4e0'))} AS Content_Reach_Score,
  Ad_Opportunity_Score
FROM (
  SELECT a.*, edges, Total_View_Duration_Mins / 60e0 AS Total_Engagement_Hours, {_engagement} AS Engagement_Score,
    {_penetration} AS Customer_Penetration, {_frequency} AS Viewing_Frequency,
    {_opportunity} AS Ad_Opportunity_Score
  FROM content_agg a CROSS JOIN (
    SELECT max(Total_Views) AS views, max(Average_View_Duration_Mins) AS duration,
      max(Unique_Customer_Count) AS uniques, quantile_cont(Total_Views, [0.25, 0.5, 0.75]) AS edges
    FROM content_agg)) scored
LEFT JOIN (SELECT Program_Genre, Genre_Strength_Index FROM genre_strength) USING (Program_Genre)
LEFT JOIN (SELECT Device_Type, Device_Adoption_Index FROM device_adoption) USING (Device_Type)
"""


def with_tables(body: str) -> str:
    """The query with the table expressions it needs in front."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(CTES[name])

    add(body)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body
