"""Names, labels and cut points that results must agree on.

Nothing here is logic; the plans read these tables and turn them into expressions.
"""

from datetime import date

# Fixed: the reporting date all day counts are measured from.
AS_OF = date(2026, 3, 13)

# Fixed: bronze columns, in file order, with their Spark types.
CUSTOMER_COLUMNS = [
    ("Customer_ID", "bigint"),
    ("Name", "string"),
    ("Email", "string"),
    ("Phone", "string"),
    ("Address", "string"),
    ("City", "string"),
    ("State", "string"),
    ("Zip_Code", "string"),
    ("Subscription_Type", "string"),
    ("Service_Tier", "string"),
    ("Monthly_Bill", "double"),
    ("Join_Date", "date"),
    ("Payment_Status", "string"),
    ("Region", "string"),
    ("Contract_End", "date"),
    ("Age_Group", "string"),
    ("Employment_Status", "string"),
    ("Customer_Lifetime_Value", "double"),
    ("Loyalty_Points", "bigint"),
    ("Churn_Risk", "string"),
    ("Number_Of_Devices", "int"),
    ("Has_Outdoor_Dish", "boolean"),
    ("Auto_Pay_Enabled", "boolean"),
    ("Paperless_Billing", "boolean"),
    ("Last_Payment_Date", "date"),
]

TICKET_COLUMNS = [
    ("Ticket_ID", "bigint"),
    ("Customer_ID", "bigint"),
    ("Equipment_Model", "string"),
    ("Issue_Category", "string"),
    ("Priority_Level", "string"),
    ("Signal_Strength_dBm", "double"),
    ("Technician_Assigned", "string"),
    ("Department", "string"),
    ("Created_Date", "timestamp_ntz"),
    ("Resolved_Date", "timestamp_ntz"),
    ("Resolution_Time_Hrs", "int"),
    ("Status", "string"),
    ("Customer_Satisfaction_Rating", "double"),
    ("Escalation_Flag", "boolean"),
    ("First_Contact_Resolution", "boolean"),
    ("Technician_Expertise_Level", "string"),
    ("Remote_Resolution_Attempted", "boolean"),
    ("On_Site_Visit_Required", "boolean"),
    ("Cost_Of_Resolution", "double"),
    ("Parts_Replaced", "boolean"),
]

LOG_COLUMNS = [
    ("Log_ID", "bigint"),
    ("Customer_ID", "bigint"),
    ("Channel_Name", "string"),
    ("Program_Genre", "string"),
    ("Device_Type", "string"),
    ("Network_Type", "string"),
    ("View_Duration_Mins", "int"),
    ("Stream_Quality", "string"),
    ("Video_Resolution", "string"),
    ("Buffering_Events", "double"),
    ("Start_Time", "timestamp_ntz"),
    ("End_Time", "timestamp_ntz"),
    ("Timestamp", "timestamp_ntz"),
    ("Content_Type", "string"),
    ("Playback_Speed", "string"),
    ("Subtitles_Enabled", "boolean"),
    ("Closed_Captions_Enabled", "boolean"),
    ("DVR_Playback", "boolean"),
    ("Skip_Ads", "boolean"),
    ("User_Rating", "double"),
    ("Autoplay_Triggered", "boolean"),
]

# Fixed: text a CSV cell may hold for "no value".
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Fixed: which columns each cleaning rule touches.
CUSTOMER_TITLE_CASE = ["Subscription_Type", "Service_Tier", "Employment_Status", "Name", "City"]
CUSTOMER_UPPER_CASE = ["State"]
TICKET_TITLE_CASE = ["Status", "Equipment_Model", "Issue_Category", "Department", "Technician_Assigned"]
LOG_TITLE_CASE = ["Device_Type", "Channel_Name", "Program_Genre", "Content_Type"]
LOG_UPPER_CASE = ["Stream_Quality", "Video_Resolution"]

# Fixed: placeholders and caps.
UNKNOWN_PHONE = "Unknown"
UNASSIGNED_TECHNICIAN = "Unassigned"
MAX_VIEW_MINUTES = 480
DEFAULT_QUALITY = "HD"

# Fixed: stand-ins when an optional column is missing from the input.
DEFAULT_RATING = 4.0
DEFAULT_FIRST_CONTACT_RATE = 0.7
DEFAULT_REMOTE_RATE = 0.5
DEFAULT_COST = 150
DEFAULT_HIGH_PRIORITY_RATE = 0.2
DEFAULT_ESCALATION_RATE = 0.1
DEFAULT_BUFFERING = 0
DEFAULT_SLA = "<24h"
DEFAULT_IMPACT = 50
DEFAULT_PERFORMANCE = 75

# Fixed: customer rules.
BILL_BANDS = [(0, 80, "Low"), (80, 150, "Medium"), (150, None, "High")]
HEALTH_WEIGHTS = {"signal": 0.3, "volume": 0.3, "satisfaction": 0.4}
PAYMENT_RISK = {"Pending": 30, "Disputed": 50}
PAYMENT_RISK_OTHER = 10
CHURN_BELOW = [(40, "High"), (70, "Medium")]
CHURN_OTHER = "Low"
RENEWAL_BELOW = [(30, "Expiring Soon"), (90, "At Risk")]
RENEWAL_OTHER = "Stable"
REVENUE_HEALTH_BELOW = [(100, "Undermonetized"), (180, "Optimal")]
REVENUE_HEALTH_OTHER = "Premium"

# Fixed: ticket rules.
TECHNICIAN_WEIGHTS = [
    ("Speed_Score", 0.25),
    ("Satisfaction_Score", 0.35),
    ("FCR_Score", 0.25),
    ("Cost_Efficiency_Score", 0.15),
]
PERFORMANCE_AT_LEAST = [(85, "Expert"), (70, "Proficient")]
PERFORMANCE_OTHER = "Developing"
RESOLUTION_BANDS = [(0, 4, "Critical_4h"), (4, 24, "High_24h"), (24, 72, "Medium_72h"), (72, None, "Low_Extended")]
SIGNAL_AT_LEAST = [(-50, "Excellent"), (-70, "Good"), (-85, "Fair")]
SIGNAL_OTHER = "Poor"
SLA_HOURS = {"Critical": 4, "High": 8, "Medium": 24, "Low": 72}
SLA_HOURS_OTHER = 72
SLA_TEXT = {"Critical": "<4h", "High": "<8h", "Medium": "<24h"}
SLA_TEXT_OTHER = "<72h"

# Fixed: viewing rules.
CONTENT_KEYS = ["Program_Genre", "Channel_Name", "Device_Type", "Stream_Quality"]
BUFFERING_ABOVE = [(5, "Poor"), (2, "Fair"), (0, "Good")]
BUFFERING_OTHER = "Excellent"
POPULARITY_LABELS = ["Low", "Medium", "High", "Viral"]
CONTENT_HEALTH_AT_LEAST = [(75, "Excellent"), (50, "Healthy"), (25, "At_Risk")]
CONTENT_HEALTH_OTHER = "Critical"

# Fixed: gold columns, in file order.
GOLD_BILLING = [
    "Customer_ID", "Name", "City", "State", "Region", "Email",
    "Subscription_Type", "Service_Tier", "Monthly_Bill", "Monthly_Revenue",
    "Bill_Category", "Payment_Status", "Payment_Risk_Score", "Payment_Days_Overdue",
    "Customer_Tenure_Years", "Join_Date", "Contract_Renewal_Risk",
    "Auto_Pay_Enabled", "Paperless_Billing",
    "Total_Tickets", "Avg_Resolution_Time", "Critical_Escalations",
    "Avg_Satisfaction", "FCR_Rate", "Avg_Signal_Strength",
    "Service_Health_Score", "Churn_Risk", "Calculated_Churn_Risk",
    "Customer_Lifetime_Value", "LTV_Index", "Loyalty_Points", "Loyalty_Index",
    "Number_Of_Devices", "Device_Adoption_Score", "Age_Group", "Employment_Status",
    "Revenue_Health", "Customer_Segment",
]

# Fixed: (column, column that takes its place when it is missing).
GOLD_OPERATIONS = [
    ("Ticket_ID", None), ("Customer_ID", None), ("Equipment_Model", None), ("Issue_Category", None),
    ("Priority_Level", "Status"), ("Status", None), ("Department", "Issue_Category"),
    ("Technician_Assigned", None), ("Overall_Performance_Score", None), ("Performance_Tier", None),
    ("Created_Date", "Ticket_ID"), ("Resolution_Time_Hrs", None), ("Resolution_Efficiency", None),
    ("Issue_Resolution_Time", None), ("Signal_Quality", None), ("Reliability_Index", None),
    ("Customer_Satisfaction_Rating", "Ticket_ID"), ("Escalation_Flag", "Status"),
    ("First_Contact_Resolution", "Status"), ("Remote_Resolution_Attempted", "Status"),
    ("Cost_Of_Resolution", "Ticket_ID"), ("Issue_Impact_Score", None),
]

GOLD_CONTENT = [
    "Program_Genre", "Channel_Name", "Device_Type", "Stream_Quality",
    "Total_View_Duration_Mins", "Total_Engagement_Hours", "Average_View_Duration_Mins",
    "Total_Views", "Unique_Customer_Count", "Avg_Buffering_Events", "Avg_User_Rating",
    "Quality_Satisfaction", "Engagement_Score", "Popularity_Tier", "Customer_Penetration",
    "Genre_Strength_Index", "Device_Adoption_Index", "Content_Health",
    "Viewing_Frequency", "Content_Reach_Score", "Ad_Opportunity_Score",
]

# Fixed: columns of the dashboards' detail tables.
BILLING_DETAIL = [
    "Customer_ID", "Name", "Region", "Monthly_Bill", "Service_Tier", "Service_Health_Score",
    "Payment_Status", "Calculated_Churn_Risk", "Customer_Segment",
]
BILLING_DETAIL_SHORT = ["Customer_ID", "Region", "Monthly_Bill"]
CONTENT_DETAIL = [
    "Program_Genre", "Channel_Name", "Device_Type", "Total_Views", "Unique_Customer_Count",
    "Avg_User_Rating", "Engagement_Score", "Content_Health", "Content_Reach_Score",
]
OPERATIONS_DETAIL = [
    "Ticket_ID", "Customer_ID", "Equipment_Model", "Issue_Category", "Status",
    "Resolution_Time_Hrs", "Performance_Tier", "Overall_Performance_Score",
    "Customer_Satisfaction_Rating", "Signal_Quality",
]
SHUFFLE_SEED = 42
