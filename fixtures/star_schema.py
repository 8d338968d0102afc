"""Bronze tables derived from a star schema of customers, orders and events.

Each is one pass over its fact table. Key arithmetic plants the defects real feeds have:
missing values, repeated customers, outliers, future dates, mixed case, orphans.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewmart.schemas import bronze_names


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(number: Column, *texts: str | None) -> Column:
    """The text at position ``number``; the last one for all higher numbers."""
    chain = F
    for place, text in enumerate(texts[:-1]):
        chain = chain.when(number == place, F.lit(text))
    return chain.otherwise(F.lit(texts[-1]))


def _day(first: str, offset: Column) -> Column:
    return F.date_add(F.lit(first).cast("date"), offset.cast("int"))


def _div(number: Column, by: int) -> Column:
    return F.floor(number / F.lit(float(by)))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    ck = F.col("c_custkey")
    cents = F.round(F.abs("c_acctbal") * 100).cast("long")
    copies = F.when(ck % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    second = F.col("copy") == 1
    bill = F.when(ck % 20 == 7, None).when(ck % 240 == 3, (500_000 + _div(cents, 5)) / F.lit(100.0)).otherwise(
        (5_000 + _div(cents, 50)) / F.lit(100.0)
    )
    base = (
        _table(spark, folder, "customer")
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .withColumn("copy", F.explode(copies))
    )
    columns = {
        "Customer_ID": ck,
        "Name": F.concat(F.when(second, "dup ").otherwise(""), F.lower("c_name")),
        "Email": F.concat(F.lit("user"), ck, F.lit("@mail.test")),
        "Phone": F.when(ck % 50 != 9, F.concat(F.lit("ph"), ck)),
        "Address": F.concat(ck, F.lit(' main st, unit "'), ck % 100, F.lit('"')),
        "City": F.col("n_name"),
        "State": F.lower("n_name"),
        "Zip_Code": F.lpad((ck % 100_000).cast("string"), 5, "0"),
        "Subscription_Type": _pick(
            ck % 7, "family's top 120", "FAMILY'S TOP 250", "orange saver", "Spanish Premium"
        ),
        "Service_Tier": F.col("c_mktsegment"),
        "Monthly_Bill": F.when(second & (ck % 100 == 0), bill + 1).otherwise(bill),
        "Join_Date": F.when(ck % 120 == 5, F.lit("2027-06-01").cast("date")).otherwise(
            _day("2021-03-13", (ck * 7) % 1826)
        ),
        "Payment_Status": _pick(_div(ck, 3) % 4, "Paid", "Pending", "Overdue", "Disputed"),
        "Region": F.col("r_name"),
        "Contract_End": _day("2026-03-13", (ck * 13) % 730),
        "Age_Group": _pick(ck % 6, "18-25", "26-35", "36-45", "46-55", "56-65", "65+"),
        "Employment_Status": _pick(ck % 5, "employed", "SELF-EMPLOYED", "Retired", "student", "Unemployed"),
        "Customer_Lifetime_Value": F.abs("c_acctbal") * F.lit(1.45) + F.lit(500.0),
        "Loyalty_Points": (ck * 37) % 50_001,
        "Churn_Risk": _pick(ck % 3, "Low", "Medium", "High"),
        "Number_Of_Devices": (ck % 8 + 1).cast("int"),
        "Has_Outdoor_Dish": ck % 2 == 0,
        "Auto_Pay_Enabled": ck % 3 == 0,
        "Paperless_Billing": ck % 4 == 0,
        "Last_Payment_Date": _day("2026-03-13", -((ck * 11) % 90)),
    }
    return base.select(
        *[columns[name].alias(name) for name in bronze_names("customers")],
        (ck * 2 + F.col("copy")).alias("ingest_seq"),
    )


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    # Every order is a ticket; a fifth of the customers hand theirs to the next one and have none.
    ok, custkey = F.col("o_orderkey"), F.col("o_custkey")
    oc = F.when(custkey % 5 == 0, custkey + 1).otherwise(custkey)
    person = (ok * 7) % 300
    level = F.substring("o_orderpriority", 1, 1)
    rated = (
        F.when(oc % 25 == 1, 1.0)
        .when(ok % 33 == 5, None)
        .when(person < 60, 4.5 + (oc % 2) * 0.5)
        .when(person < 120, 4.0 + (oc % 3) * 0.5)
        .otherwise(1 + ((oc * 19) % 9) * 0.5)
    )
    hours = F.when(person < 60, 1 + oc % 6).when(person < 120, 1 + oc % 20).otherwise(1 + (oc * 31) % 80)
    cost = F.when(person < 60, oc % 20).when(person < 120, oc % 150).otherwise((oc * 23) % 500)
    columns = {
        "Ticket_ID": ok,
        "Customer_ID": F.when(ok % 211 == 5, -oc).otherwise(oc),
        "Equipment_Model": _pick(ok % 7, "gateway 3", "MINI", "relay", "4K Mini", "Outdoor Antenna"),
        "Issue_Category": _pick(oc % 4, "signal loss", "HARDWARE failure", "Billing", "remote pairing"),
        "Priority_Level": F.when(level == "1", "Critical")
        .when(level == "2", "High")
        .when(level == "3", "Medium")
        .otherwise("Low"),
        "Signal_Strength_dBm": F.when(ok % 20 != 11, (-30 - (ok * 17) % 71).cast("double")),
        "Technician_Assigned": F.when(ok % 50 != 13, F.concat(F.lit("tech "), person)),
        "Department": F.when(
            ok % 101 != 7,
            _pick(oc % 6, "technical SUPPORT", "billing", "Installation", "sales", "network operations", "Equipment support"),
        ),
        "Created_Date": F.col("o_orderdate"),
        "Resolved_Date": F.col("o_orderdate") + F.make_dt_interval(hours=((ok * 29) % 120 - 8).cast("int")),
        "Resolution_Time_Hrs": hours.cast("int"),
        "Status": F.when(F.col("o_orderstatus") == "F", "CLOSED")
        .when(F.col("o_orderstatus") == "O", "open")
        .otherwise("In Progress"),
        "Customer_Satisfaction_Rating": rated.cast("double"),
        "Escalation_Flag": ok % 2 == 0,
        "First_Contact_Resolution": (person < 60) | ((person < 120) & (oc % 4 != 0)) | (oc % 3 == 0),
        "Technician_Expertise_Level": _pick(oc % 3, "Junior", "Senior", "Expert"),
        "Remote_Resolution_Attempted": oc % 2 == 0,
        "On_Site_Visit_Required": oc % 3 == 1,
        "Cost_Of_Resolution": cost.cast("double"),
        "Parts_Replaced": ok % 4 == 0,
    }
    return (
        _table(spark, folder, "orders")
        .select(*[columns[name].alias(name) for name in bronze_names("tickets")])
    )


def misspelled_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Tickets as careless people enter them: some states and departments lack or gain letters."""
    ok, status, department = F.col("Ticket_ID"), F.col("Status"), F.col("Department")
    spelled = {
        "Status": F.when((status == "CLOSED") & (ok % 37 == 3), "Clsd")
        .when((status == "CLOSED") & (ok % 41 == 5), " closed.")
        .when((status == "In Progress") & (ok % 43 == 7), "in-Progres")
        .otherwise(status),
        "Department": F.when((department == "billing") & (ok % 31 == 2), "Biling")
        .when((department == "Installation") & (ok % 29 == 4), "Instalation")
        .when((department == "network operations") & (ok % 23 == 9), "Netwark Operations")
        .otherwise(department),
    }
    return tickets(spark, folder).withColumns(spelled)


def viewing_logs(spark: SparkSession, folder: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.col("event_type") == "error"
    minutes = (
        F.when(e % 97 == 0, 5000)
        .when(error, 5 + F.floor(F.col("value") / 8).cast("int"))
        .otherwise(5 + F.floor("value").cast("int"))
        .cast("int")
    )
    columns = {
        "Log_ID": e,
        "Customer_ID": F.when(e % 307 == 11, -u).otherwise(u),
        "Channel_Name": F.concat(F.lit("ch "), F.when(error, k % 20).otherwise(k % 8)),
        "Program_Genre": F.col("event_type"),
        "Device_Type": _pick(u % 3, "Smart TV", "Set-top Box", "Tablet"),
        "Network_Type": _pick(e % 4, "Home WiFi", "Mobile Network", "Guest WiFi", "Cellular"),
        "View_Duration_Mins": minutes,
        "Stream_Quality": F.when(e % 6 < 3, "hd").when(e % 6 < 5, "4k").otherwise("sd"),
        "Video_Resolution": _pick(e % 4, "1080p", "720P", "480p", "2160p"),
        "Buffering_Events": F.when(e % 33 == 4, None)
        .when((u % 3 == 2) & (k % 4 == 0), 0)
        .when(u % 3 == 2, e % 5)
        .otherwise(e % 16)
        .cast("double"),
        "Start_Time": F.col("ts"),
        "End_Time": F.col("ts") + F.make_dt_interval(mins=F.when(e % 89 == 0, -30).otherwise(minutes)),
        "Timestamp": F.col("ts"),
        "Content_Type": _pick(e % 3, "live", "On-demand", "RECORDED"),
        "Playback_Speed": _pick(e % 4, "1x", "1.5x", "2x", "0.5x"),
        "Subtitles_Enabled": e % 2 == 0,
        "Closed_Captions_Enabled": e % 3 == 0,
        "DVR_Playback": e % 4 == 0,
        "Skip_Ads": e % 5 == 0,
        "User_Rating": F.when(error, 1).when(e % 6 == 5, None).otherwise((e * 3) % 5 + 1).cast("double"),
        "Autoplay_Triggered": e % 7 == 0,
    }
    return _table(spark, folder, "events").select(
        *[columns[name].alias(name) for name in bronze_names("viewing_logs")]
    )


BRONZE = {"customers": customers, "tickets": tickets, "viewing_logs": viewing_logs}
