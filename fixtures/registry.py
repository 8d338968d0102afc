"""Every query by name: ``query(spark, folder) -> DataFrame`` over the star-schema tables.

Silver and gold tables are stored once per session and folder, as a medallion deployment
stores them; queries on a layer read the stored tables below it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fixtures import star_schema
from viewmart import fixed_values as fv
from viewmart.functions import title_case
from viewmart.operators import impute, keep_first, with_class_names
from viewmart.plans import (
    audits, billing, cards, content, dash_billing, dash_content, dash_operations, executive, incremental, medallion, operations, silver,
    viewers,
)
from viewmart.session import new_folder, settle
from viewmart.sources import bronze_csv
from viewmart.sources.formats import chosen_formats
from viewmart.sources.layers import read_chosen, read_layer, write_layer
from viewmart.sources.reload import LayerCache

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The layer tables of one input folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stored: dict[str, DataFrame] = {}
        self._base: str | None = None

    def _store(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        if label not in self._stored:
            self._stored[label] = settle(build(), label)
        return self._stored[label]

    def bronze(self, table: str) -> DataFrame:
        """A plan over the given tables, so that a query reads the columns it needs and no more."""
        return star_schema.BRONZE[table](self.spark, self.folder)

    def all_bronze(self) -> dict[str, DataFrame]:
        return {table: self.bronze(table) for table in medallion.SILVER_TABLES}

    def _silver(self, table: str, build: Callable[[], DataFrame]) -> DataFrame:
        if table not in self._stored:
            self._base = self._base or new_folder(self.spark, "silver")
            self._stored[table] = write_layer(build(), self._base, "silver", table)
        return self._stored[table]

    @property
    def customers(self) -> DataFrame:
        return self._silver("customers", lambda: silver.silver_customers(self.bronze("customers")))

    @property
    def tickets(self) -> DataFrame:
        return self._silver("tickets", lambda: silver.silver_tickets(self.bronze("tickets")))

    @property
    def logs(self) -> DataFrame:
        return self._silver("viewing_logs", lambda: silver.silver_logs(self.bronze("viewing_logs")))

    def silver_base(self) -> str:
        """Where all three silver tables are stored as a layer."""
        _ = self.customers, self.tickets, self.logs
        return self._base

    @property
    def billing(self) -> DataFrame:
        return self._store("gold-billing", lambda: billing.gold_billing(self.customers, self.tickets))

    @property
    def operations(self) -> DataFrame:
        return self._store("gold-operations", lambda: operations.gold_operations(self.tickets))

    @property
    def content(self) -> DataFrame:
        return self._store("gold-content", lambda: content.gold_content(self.logs))

    # Group tables that several KPI queries share.

    @property
    def technicians(self) -> DataFrame:
        return self._store("technician-stats", lambda: operations.technician_stats(self.tickets))

    @property
    def equipment(self) -> DataFrame:
        return self._store("equipment-stats", lambda: operations.equipment_stats(self.tickets))

    @property
    def departments(self) -> DataFrame:
        return self._store("department-stats", lambda: operations.department_stats(self.tickets))

    @property
    def cells(self) -> DataFrame:
        return self._store("content-agg", lambda: content.content_agg(self.logs))


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractions to a fixed number of digits, so that sums in any order compare equal."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


# --- sources, sinks and layer jobs -------------------------------------------------------


def _scan(table: str) -> Callable[[Tables], DataFrame]:
    """Export the bronze table to CSV and scan that with the declared schema."""

    def run(t: Tables) -> DataFrame:
        path = new_folder(t.spark, f"csv-{table}")
        bronze_csv.write_csv(bronze_csv.bronze_only(t.bronze(table), table), path)
        return bronze_csv.bronze_only(bronze_csv.read_bronze_csv(t.spark, path, table), table)

    return run


def _write_layer(t: Tables) -> DataFrame:
    base = new_folder(t.spark, "write-layer")
    for table, df in t.all_bronze().items():
        write_layer(df, base, "bronze", table, csv_copy=True)
    stored = {table: read_layer(t.spark, base, "bronze", table) for table in medallion.SILVER_TABLES}
    return medallion.contents(stored)


def _layer_silver(t: Tables) -> DataFrame:
    return medallion.contents(medallion.run_silver(t.all_bronze(), new_folder(t.spark, "layer-silver")))


def _layer_gold(t: Tables) -> DataFrame:
    return medallion.contents(medallion.run_gold(t.spark, new_folder(t.spark, "layer-gold"), silver_base=t.silver_base()))


def _gold_chosen(t: Tables) -> DataFrame:
    """Gold stored in the order of its filters, and what the dashboards' choices read of it."""
    base = new_folder(t.spark, "gold-chosen")
    medallion.run_gold(t.spark, base, clustered=True, files=16, silver_base=t.silver_base())
    choices = {
        "billing_segmentation": {"Region": _CHOSEN_CUSTOMERS["regions"], "Customer_Segment": _CHOSEN_CUSTOMERS["segments"]},
        "content_strategy": {"Program_Genre": ["Click", "Error"], "Device_Type": ["Tablet"]},
        "network_operations": {"Department": [None, "Billing"]},
    }
    return medallion.contents({table: read_chosen(t.spark, base, "gold", table, **chosen) for table, chosen in choices.items()})


def _layer_all(t: Tables) -> DataFrame:
    return medallion.contents(medallion.run_all(t.spark, t.all_bronze(), new_folder(t.spark, "layer-all")))


# --- single rules ------------------------------------------------------------------------


#: Cells that a feed may hold where a number is declared: fine, infinite, with a decimal comma, a word.
_ODD_BILLS = {3: "inf", 5: "12,5", 7: "unknown value"}


def _odd_customers(t: Tables) -> str:
    """An export of customers in which some bills are not numbers."""
    customers = bronze_csv.bronze_only(t.bronze("customers"), "customers")
    bill = F.col("Monthly_Bill").cast("string")
    for rest, cell in _ODD_BILLS.items():
        bill = F.when(F.col("Customer_ID") % 11 == rest, cell).otherwise(bill)
    path = new_folder(t.spark, "csv-odd")
    bronze_csv.write_csv(customers.withColumn("Monthly_Bill", bill), path)
    return path


def _unreadable(t: Tables) -> DataFrame:
    """Count what cannot be read in such an export."""
    return medallion.unreadable_values({"customers": bronze_csv.read_bronze_csv(t.spark, _odd_customers(t), "customers", multi_line=True)})


def _observed(t: Tables) -> DataFrame:
    """The same counts, taken while the table is stored."""
    return medallion.take_in(t.spark, {"customers": _odd_customers(t)}, new_folder(t.spark, "take-in"))[1]


def _foreign_customers(t: Tables) -> str:
    """An export of customers from a system that writes dates and amounts in its own ways."""
    customers = bronze_csv.bronze_only(t.bronze("customers"), "customers")
    path = new_folder(t.spark, "csv-foreign")
    bronze_csv.write_csv(
        customers.withColumns(
            {
                "Join_Date": F.date_format("Join_Date", "MM/dd/yyyy"),
                "Contract_End": F.date_format("Contract_End", "d.M.yyyy"),
                "Monthly_Bill": F.translate(F.col("Monthly_Bill").cast("string"), ".", ","),
            }
        ),
        path,
    )
    return path


def _scan_formats(t: Tables) -> DataFrame:
    return bronze_csv.find_formats(t.spark, _foreign_customers(t), "customers")


def _scan_foreign(t: Tables) -> DataFrame:
    """The customers of such an export, read by the formats that were found."""
    path = _foreign_customers(t)
    formats = chosen_formats(bronze_csv.find_formats(t.spark, path, "customers"))
    return bronze_csv.bronze_only(bronze_csv.read_bronze_csv(t.spark, path, "customers", formats=formats), "customers")


def _title_case(t: Tables) -> DataFrame:
    bronze = t.bronze("tickets")
    titled = [title_case(F.col(name)).alias(f"{name}_Title") for name in fv.TICKET_TITLE_CASE]
    return bronze.select("Ticket_ID", *fv.TICKET_TITLE_CASE, *titled)


def _impute(table: str, key: str, column: str, how: str) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        narrow = t.bronze(table).select(key, F.col(column).alias("Value"))
        filled = impute(narrow, **{how: ("Value",)})
        return filled.select(key, F.col("Value").alias(column))

    return run


def _billing_kpi(*columns: str) -> Callable[[Tables], DataFrame]:
    return lambda t: billing.enrich_customers(t.customers, t.tickets).select("Customer_ID", *columns)


def _customer_kpi(name: str, kpi: Callable[[], Column]) -> Callable[[Tables], DataFrame]:
    """A KPI of the customers table alone, without the ticket join."""
    return lambda t: t.customers.select("Customer_ID", kpi().alias(name))


def _cell_kpi(*columns: str) -> Callable[[Tables], DataFrame]:
    return lambda t: content.cell_scores(t.cells).select(*fv.CONTENT_KEYS, *columns)


def _ltv_index(t: Tables) -> DataFrame:
    filled = t.customers.fillna(0)
    return billing.with_customer_ranges(filled, t.customers).select("Customer_ID", billing.ltv_index().alias("LTV_Index"))


def _loyalty_index(t: Tables) -> DataFrame:
    filled = t.customers.fillna(0).withColumn("Customer_Tenure_Years", billing.tenure_years(fv.AS_OF))
    return billing.with_customer_ranges(filled, t.customers).select(
        "Customer_ID", billing.loyalty_index().alias("Loyalty_Index")
    )


def _payment_risk(t: Tables) -> DataFrame:
    timed = t.customers.withColumn("Payment_Days_Overdue", billing.payment_days(fv.AS_OF))
    return timed.select(
        "Customer_ID", "Payment_Status", "Payment_Days_Overdue", billing.payment_risk_score().alias("Payment_Risk_Score")
    )


def _renewal(t: Tables) -> DataFrame:
    timed = t.customers.withColumn("Days_Until_Contract_End", billing.contract_days(fv.AS_OF))
    return timed.select("Customer_ID", "Days_Until_Contract_End", billing.renewal_risk().alias("Contract_Renewal_Risk"))


def _impact_joined(t: Tables) -> DataFrame:
    joined = operations.tickets_with_customer_metrics(t.tickets)
    return joined.select("Ticket_ID", operations.impact_score(joined).alias("Issue_Impact_Score"))


def _guard_defaults(t: Tables) -> DataFrame:
    """Technician measures and scores where the feed lacks every optional column."""
    bare = t.tickets.drop(
        "Customer_Satisfaction_Rating", "First_Contact_Resolution", "Remote_Resolution_Attempted", "Cost_Of_Resolution"
    )
    return operations.technician_scores(settle(operations.technician_stats(bare), "technicians-bare"))


def _category_variants(t: Tables) -> DataFrame:
    return audits.category_variants(
        {
            "customers": (t.bronze("customers"), ["Subscription_Type", "Service_Tier", "Employment_Status", "State"]),
            "tickets": (t.bronze("tickets"), ["Status", "Equipment_Model", "Issue_Category", "Department"]),
            "viewing_logs": (t.bronze("viewing_logs"), ["Stream_Quality", "Video_Resolution", "Content_Type"]),
        }
    )


def _misspelled(t: Tables) -> DataFrame:
    return star_schema.misspelled_tickets(t.spark, t.folder)


def _spelling_clusters(t: Tables) -> DataFrame:
    return audits.spelling_classes(
        {
            "customers": (t.bronze("customers"), ["Subscription_Type", "Service_Tier", "Employment_Status", "State"]),
            "tickets": (_misspelled(t), ["Status", "Equipment_Model", "Issue_Category", "Department"]),
            "viewing_logs": (t.bronze("viewing_logs"), ["Stream_Quality", "Video_Resolution", "Content_Type"]),
        }
    )


def _unified_tickets(t: Tables) -> DataFrame:
    tickets = _misspelled(t)
    classes = audits.spelling_classes({"tickets": (tickets, ["Status", "Department"])})
    for column in ("Status", "Department"):
        tickets = with_class_names(tickets, column, settle(classes.where(F.col("Column_Name") == column), "spellings"))
    return tickets.groupBy("Status", "Department").agg(F.count("*").alias("Tickets"))


def _layer_reload(t: Tables) -> DataFrame:
    """What a dashboard's cache shows of a table that is published again behind it."""
    base, now, seen = new_folder(t.spark, "layer-reload"), [0.0], []
    customers = t.bronze("customers")
    cache = LayerCache(t.spark, base, layer="bronze", seconds=300, clock=lambda: now[0])

    def look(step: str) -> None:
        regions = cache.get("customers").groupBy("Region").agg(F.count("*").alias("Row_Count"))
        seen.append(settle(regions.select(F.lit(step).alias("Step"), "Region", "Row_Count"), "reload"))

    write_layer(customers.where(F.col("Region") != "ASIA"), base, "bronze", "customers")
    look("first load")
    write_layer(customers, base, "bronze", "customers")
    look("before expiry")
    now[0] = 301.0
    look("after expiry")
    write_layer(customers.where(F.col("Region") == "ASIA"), base, "bronze", "customers")
    look("before clear")
    cache.clear()
    look("after clear")
    cache.clear()
    result = seen[0]
    for part in seen[1:]:
        result = result.unionByName(part)
    return result


def _distinct_viewers(t: Tables) -> DataFrame:
    sketches = settle(viewers.viewer_sketches(t.logs), "viewer-sketches")
    by_key = [viewers.viewer_check(sketches, t.logs, by) for by in fv.CONTENT_KEYS]
    filtered = viewers.viewer_check(sketches, t.logs, "Program_Genre", devices=["Smart Tv", "Tablet"])
    result = filtered.withColumn("Dimension", F.lit("Program_Genre on two devices"))
    for part in by_key:
        result = result.unionByName(part)
    return result


#: The rows of a first load; a second copy of a customer comes in the second one.
_FIRST_LOAD = {"customers": "ingest_seq % 4 = 0", "tickets": "Ticket_ID % 3 = 0", "viewing_logs": "Log_ID % 3 = 0"}


def _incremental_silver(t: Tables) -> DataFrame:
    """Two loads a table, which give the silver of one."""
    base, stored = new_folder(t.spark, "incremental"), {}
    for table, df in t.all_bronze().items():
        first = F.coalesce(F.expr(_FIRST_LOAD[table]), F.lit(False))
        incremental.load_increment(df.where(first), base, table, 1)
        stored[table] = incremental.load_increment(df.where(~first), base, table, 2)
    return medallion.contents(stored)


_ID_NAME_BILL = ["Customer_ID", "ingest_seq", "Name", "Monthly_Bill"]
_CHOSEN_CUSTOMERS = {"regions": ["ASIA", "EUROPE"], "segments": ["VIP_Advocates", "Standard"]}

PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    # sources, sinks, layer jobs
    "layer_reload": _layer_reload,
    "incremental_silver": _incremental_silver,
    "d2_distinct_viewers": _distinct_viewers,
    "scan_customers": _scan("customers"),
    "scan_tickets": _scan("tickets"),
    "scan_logs": _scan("viewing_logs"),
    "scan_formats": _scan_formats,
    "scan_foreign_customers": _scan_foreign,
    "unreadable_values": _unreadable,
    "observed_unreadable": _observed,
    "write_layer": _write_layer,
    "layer_silver": _layer_silver,
    "layer_gold": _layer_gold,
    "layer_all": _layer_all,
    "gold_chosen": _gold_chosen,
    # cleaning rules
    "title_case": _title_case,
    "clamp_future_join": lambda t: silver.clamp_future(t.bronze("customers"), "Join_Date", fv.AS_OF).select(
        "Customer_ID", "ingest_seq", "Join_Date"
    ),
    "dedup_customers": lambda t: keep_first(t.bronze("customers").select(_ID_NAME_BILL), "Customer_ID", "ingest_seq"),
    "impute_monthly_bill": _impute("customers", "ingest_seq", "Monthly_Bill", "medians"),
    "impute_signal": _impute("tickets", "Ticket_ID", "Signal_Strength_dBm", "means"),
    "impute_satisfaction": _impute("tickets", "Ticket_ID", "Customer_Satisfaction_Rating", "medians"),
    "impute_buffering": _impute("viewing_logs", "Log_ID", "Buffering_Events", "means"),
    "impute_rating": _impute("viewing_logs", "Log_ID", "User_Rating", "medians"),
    "guard_defaults": _guard_defaults,
    # silver
    "silver_customers": lambda t: silver.silver_customers(t.bronze("customers")),
    "silver_tickets": lambda t: silver.silver_tickets(t.bronze("tickets")),
    "silver_logs": lambda t: silver.silver_logs(t.bronze("viewing_logs")),
    # gold billing
    "customer_ticket_metrics": lambda t: billing.ticket_metrics(t.tickets),
    "customer_ticket_join": lambda t: billing.customers_with_tickets(t.customers, t.tickets),
    "customer_tenure": _customer_kpi("Customer_Tenure_Years", lambda: billing.tenure_years(fv.AS_OF)),
    "bill_category": _customer_kpi("Bill_Category", billing.bill_category),
    "monthly_revenue": _customer_kpi("Monthly_Revenue", billing.monthly_revenue),
    "service_health_score": lambda t: billing.customers_with_tickets(
        t.customers.select("Customer_ID"), t.tickets
    ).select("Customer_ID", billing.service_health_score().alias("Service_Health_Score")),
    "payment_days": _customer_kpi("Payment_Days_Overdue", lambda: billing.payment_days(fv.AS_OF)),
    "payment_risk_score": _payment_risk,
    "churn_risk": _billing_kpi("Service_Health_Score", "Calculated_Churn_Risk"),
    "ltv_index": _ltv_index,
    "loyalty_index": _loyalty_index,
    "device_adoption_score": _customer_kpi("Device_Adoption_Score", billing.device_adoption_score),
    "contract_renewal_risk": _renewal,
    "revenue_health": _customer_kpi("Revenue_Health", billing.revenue_health),
    "customer_segment": _billing_kpi("Service_Health_Score", "LTV_Index", "Customer_Segment"),
    "gold_billing": lambda t: billing.gold_billing(t.customers, t.tickets),
    # gold operations
    "technician_stats": lambda t: operations.technician_stats(t.tickets),
    "technician_scores": lambda t: operations.technician_scores(t.technicians),
    "performance_tier": lambda t: operations.technician_scores(t.technicians).select(
        "Technician_Assigned", "Overall_Performance_Score", "Performance_Tier"
    ),
    "equipment_stats": lambda t: operations.equipment_stats(t.tickets),
    "equipment_reliability": lambda t: operations.equipment_reliability(t.equipment),
    "department_stats": lambda t: operations.department_stats(t.tickets),
    "department_efficiency": lambda t: operations.department_efficiency(t.departments),
    "ticket_technician_join": lambda t: operations.with_technicians(
        t.tickets.select("Ticket_ID", "Technician_Assigned"), operations.work_cells(t.tickets)
    ),
    "ticket_equipment_join": lambda t: operations.with_equipment(
        t.tickets.select("Ticket_ID", "Equipment_Model"), operations.work_cells(t.tickets)
    ),
    "ticket_department_join": lambda t: operations.with_departments(
        t.tickets.select("Ticket_ID", "Department"), t.tickets
    ),
    "resolution_efficiency": lambda t: operations.with_resolution_efficiency(
        t.tickets.select("Ticket_ID", "Resolution_Time_Hrs"), operations.work_cells(t.tickets)
    ),
    "issue_resolution_bucket": lambda t: t.tickets.select(
        "Ticket_ID", "Resolution_Time_Hrs", operations.resolution_band().alias("Issue_Resolution_Time")
    ),
    "signal_quality": lambda t: t.tickets.select(
        "Ticket_ID", "Signal_Strength_dBm", operations.signal_quality().alias("Signal_Quality")
    ),
    "priority_sla": lambda t: t.tickets.select(
        "Ticket_ID", "Priority_Level", operations.response_sla(t.tickets).alias("Priority_Response_SLA")
    ),
    "sla_compliance": lambda t: operations.with_sla(t.tickets).select(
        "Ticket_ID", "Actual_Resolution_Hours", "SLA_Met", "Days_To_Resolve"
    ),
    "issue_impact_score": lambda t: t.tickets.select(
        "Ticket_ID", operations.impact_score(t.tickets).alias("Issue_Impact_Score")
    ),
    "issue_impact_score_joined": _impact_joined,
    "gold_operations": lambda t: operations.gold_operations(t.tickets),
    # gold content
    "content_agg": lambda t: content.content_agg(t.logs),
    "genre_performance": lambda t: content.genre_performance(t.logs),
    "device_performance": lambda t: content.device_performance(t.logs),
    "content_type_performance": lambda t: content.content_type_performance(t.logs),
    "quality_analysis": lambda t: content.quality_analysis(t.logs),
    "peak_analysis": lambda t: content.peak_analysis(t.logs),
    "viewing_calendar": lambda t: content.viewing_calendar(t.logs).select("Log_ID", "Hour_Of_Day", "Day_Of_Week"),
    "logs_content_type_join": lambda t: content.logs_with_content_type(t.logs.select("Log_ID", "Content_Type", "Customer_ID", "View_Duration_Mins")),
    "content_genre_join": lambda t: content.with_genres(t.cells.select(*fv.CONTENT_KEYS), content.viewer_cells(t.logs)),
    "content_device_join": lambda t: content.with_devices(t.cells.select(*fv.CONTENT_KEYS), content.viewer_cells(t.logs)),
    "engagement_hours": lambda t: t.cells.select(
        *fv.CONTENT_KEYS, content.engagement_hours().alias("Total_Engagement_Hours")
    ),
    "engagement_score": _cell_kpi("Engagement_Score"),
    "quality_satisfaction": lambda t: t.cells.select(
        *fv.CONTENT_KEYS, content.quality_satisfaction().alias("Quality_Satisfaction")
    ),
    "popularity_tier": lambda t: content.with_popularity(t.cells, t.cells).select(
        *fv.CONTENT_KEYS, "Total_Views", "Popularity_Tier"
    ),
    "customer_penetration": _cell_kpi("Customer_Penetration"),
    "genre_strength_index": lambda t: content.genre_strength(settle(content.genre_viewers(content.viewer_cells(t.logs)), "genres")),
    "device_adoption_index": lambda t: content.device_adoption(settle(content.device_views(content.viewer_cells(t.logs)), "devices")),
    "content_health": _cell_kpi("Engagement_Score", "Content_Health"),
    "viewing_frequency": lambda t: t.cells.select(*fv.CONTENT_KEYS, content.viewing_frequency().alias("Viewing_Frequency")),
    "content_reach_score": _cell_kpi("Content_Reach_Score"),
    "ad_opportunity_score": _cell_kpi("Ad_Opportunity_Score"),
    "gold_content": lambda t: content.gold_content(t.logs),
    # dashboard 1: billing
    "d1_options": lambda t: dash_billing.options(t.billing),
    "d1_filtered": lambda t: dash_billing.chosen(t.billing, **_CHOSEN_CUSTOMERS),
    "d1_filtered_revenue_by_region": lambda t: dash_billing.revenue_by_region(
        dash_billing.chosen(t.billing, **_CHOSEN_CUSTOMERS)
    ),
    "d1_financial_kpis": lambda t: dash_billing.financial_kpis(t.billing),
    "d1_health_kpis": lambda t: dash_billing.health_kpis(t.billing),
    "d1_revenue_by_region": lambda t: dash_billing.revenue_by_region(t.billing),
    "d1_bill_category_dist": lambda t: dash_billing.bill_category_dist(t.billing),
    "d1_revenue_by_bill_category": lambda t: dash_billing.revenue_by_bill_category(t.billing),
    "d1_health_hist": lambda t: dash_billing.health_hist(t.billing),
    "d1_churn_dist": lambda t: dash_billing.churn_dist(t.billing),
    "d1_payment_dist": lambda t: dash_billing.payment_dist(t.billing),
    "d1_contract_dist": lambda t: dash_billing.contract_dist(t.billing),
    "d1_loyalty_ltv": lambda t: dash_billing.loyalty_ltv(t.billing),
    "d1_device_hist": lambda t: dash_billing.device_hist(t.billing),
    "d1_segment_dist": lambda t: dash_billing.segment_dist(t.billing),
    "d1_segment_revenue": lambda t: dash_billing.segment_revenue(t.billing),
    "d1_detail": lambda t: dash_billing.detail(t.billing),
    "d1_page": lambda t: dash_billing.whole_page(t.billing),
    "d1_kpi_cards": lambda t: cards.billing(t.billing),
    # dashboard 2: content
    "d2_options": lambda t: dash_content.options(t.content),
    "d2_filtered": lambda t: dash_content.chosen(t.content, ["Click", "Error"], ["Tablet"]),
    "d2_filtered_kpis": lambda t: dash_content.kpis(dash_content.chosen(t.content, ["Click", "Error"], ["Tablet"])),
    "d2_kpis": lambda t: dash_content.kpis(t.content),
    "d2_genre_duration": lambda t: dash_content.genre_duration(t.content),
    "d2_device_views": lambda t: dash_content.device_views(t.content),
    "d2_engagement_hist": lambda t: dash_content.engagement_hist(t.content),
    "d2_quality_dist": lambda t: dash_content.quality_dist(t.content),
    "d2_popularity_dist": lambda t: dash_content.popularity_dist(t.content),
    "d2_health_dist": lambda t: dash_content.health_dist(t.content),
    "d2_reach_top": lambda t: dash_content.reach_top(t.content),
    "d2_engagement_rating": lambda t: dash_content.engagement_rating(t.content),
    "d2_top_viewed": lambda t: dash_content.top_viewed(t.content),
    "d2_top_rated": lambda t: dash_content.top_rated(t.content),
    "d2_detail": lambda t: dash_content.detail(t.content),
    "d2_page": lambda t: dash_content.whole_page(t.content),
    "d2_kpi_cards": lambda t: cards.content(t.content),
    # dashboard 3: operations
    "d3_options": lambda t: dash_operations.options(t.operations),
    "d3_filtered": lambda t: dash_operations.chosen(t.operations, ["4K Mini", "Relay"], ["Billing", "Sales"]),
    "d3_filtered_department_perf": lambda t: dash_operations.department_perf(
        dash_operations.chosen(t.operations, ["4K Mini", "Relay"], ["Billing", "Sales"])
    ),
    "d3_filtered_null": lambda t: dash_operations.chosen(t.operations, departments=[None, "Billing"]),
    "d3_kpis": lambda t: dash_operations.kpis(t.operations),
    "d3_resolution_hist": lambda t: dash_operations.resolution_hist(t.operations),
    "d3_efficiency_dist": lambda t: dash_operations.efficiency_dist(t.operations),
    "d3_tier_dist": lambda t: dash_operations.tier_dist(t.operations),
    "d3_score_hist": lambda t: dash_operations.score_hist(t.operations),
    "d3_equipment_dist": lambda t: dash_operations.equipment_dist(t.operations),
    "d3_reliability": lambda t: dash_operations.reliability(t.operations),
    "d3_issue_dist": lambda t: dash_operations.issue_dist(t.operations),
    "d3_impact_hist": lambda t: dash_operations.impact_hist(t.operations),
    "d3_signal_dist": lambda t: dash_operations.signal_dist(t.operations),
    "d3_satisfaction_resolution": lambda t: dash_operations.satisfaction_resolution(t.operations),
    "d3_department_perf": lambda t: dash_operations.department_perf(t.operations),
    "d3_detail": lambda t: dash_operations.detail(t.operations),
    "d3_page": lambda t: dash_operations.whole_page(t.operations),
    "d3_kpi_cards": lambda t: cards.operations(t.operations),
    # executive summary
    "exec_kpi_cards": lambda t: cards.overview(t.billing, t.operations, t.content),
    "exec_overview": lambda t: executive.overview(t.billing, t.operations, t.content),
    "exec_revenue_health": lambda t: executive.revenue_health(t.billing),
    "exec_risk": lambda t: executive.risk(t.billing),
    "exec_performance": lambda t: executive.performance(t.operations, t.content),
    "exec_revenue_at_risk": lambda t: executive.revenue_at_risk(t.billing),
    "exec_engagement_vs_rating": lambda t: executive.engagement_vs_rating(t.content),
    "layer_reconciliation": lambda t: executive.layer_reconciliation(t.bronze("viewing_logs"), t.content),
    # data quality
    "dq_null_rates": lambda t: audits.null_rates(
        {table: bronze_csv.bronze_only(df, table) for table, df in t.all_bronze().items()}
    ),
    "dq_duplicate_customers": lambda t: audits.duplicate_customers(t.bronze("customers")),
    "dq_future_dates": lambda t: audits.future_dates(t.bronze("customers")),
    "dq_outliers": lambda t: audits.outliers(t.bronze("customers"), t.bronze("viewing_logs")),
    "dq_category_variants": _category_variants,
    "dq_spelling_clusters": _spelling_clusters,
    "unified_tickets": _unified_tickets,
    "dq_negative_durations": lambda t: audits.negative_durations(t.bronze("tickets"), t.bronze("viewing_logs")),
    "dq_orphans": lambda t: audits.orphans(
        t.bronze("customers"), {"tickets": t.bronze("tickets"), "viewing_logs": t.bronze("viewing_logs")}
    ),
}


def _query(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: rounded(plan(tables(spark, folder)))


QUERIES: dict[str, Query] = {name: _query(plan) for name, plan in PLANS.items()}
