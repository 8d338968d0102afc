"""Silver tables: bronze values cleaned, columns unchanged."""

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from viewmart import fixed_values as fv
from viewmart.functions import title_case
from viewmart.operators import existing, impute, keep_first


# Columns that ingestion adds; silver tables have the bronze columns only.
_TECHNICAL = ["ingest_seq", "_bad_columns"]


def standardize(df: DataFrame, titled: list[str], upper: list[str]) -> DataFrame:
    """Settle the letter case of the given columns, as far as the table has them."""
    changes: dict[str, Column] = {name: title_case(F.col(name)) for name in existing(df, titled)}
    changes |= {name: F.upper(name) for name in existing(df, upper)}
    return df.withColumns(changes)


def as_type(df: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """Parse text columns to dates or timestamps; unreadable text becomes NULL."""
    kinds = dict(df.dtypes)
    texts = [name for name in existing(df, names) if kinds[name] == "string"]
    return df.withColumns({name: F.col(name).try_cast(kind) for name in texts})


def clamp_future(df: DataFrame, name: str, as_of: date) -> DataFrame:
    """Bring dates after the reporting date back to it; NULL stays NULL."""
    cap = F.lit(as_of)
    return df.withColumn(name, F.when(F.col(name) > cap, cap).otherwise(F.col(name)))


def cap_view_minutes(df: DataFrame) -> DataFrame:
    minutes = F.col("View_Duration_Mins")
    return df.withColumn("View_Duration_Mins", F.when(minutes > fv.MAX_VIEW_MINUTES, fv.MAX_VIEW_MINUTES).otherwise(minutes))


def customer_rows(customers: DataFrame, as_of: date = fv.AS_OF) -> DataFrame:
    """The rules that look at one customer row at a time."""
    clean = as_type(customers, "date", ["Join_Date", "Contract_End", "Last_Payment_Date"])
    clean = standardize(clean, fv.CUSTOMER_TITLE_CASE, fv.CUSTOMER_UPPER_CASE)
    clean = clean.withColumn("Phone", F.coalesce("Phone", F.lit(fv.UNKNOWN_PHONE)))
    return clamp_future(clean, "Join_Date", as_of)


def ticket_rows(tickets: DataFrame) -> DataFrame:
    """The rules that look at one ticket row at a time."""
    clean = as_type(tickets.drop(*_TECHNICAL), "timestamp_ntz", ["Created_Date", "Resolved_Date"])
    clean = standardize(clean, fv.TICKET_TITLE_CASE, [])
    return clean.withColumn(
        "Technician_Assigned", F.coalesce("Technician_Assigned", F.lit(fv.UNASSIGNED_TECHNICIAN))
    )


def log_rows(logs: DataFrame) -> DataFrame:
    """The rules that look at one log row at a time."""
    clean = as_type(logs.drop(*_TECHNICAL), "timestamp_ntz", ["Timestamp", "Start_Time", "End_Time"])
    return cap_view_minutes(standardize(clean, fv.LOG_TITLE_CASE, fv.LOG_UPPER_CASE))


def silver_customers(bronze: DataFrame, as_of: date = fv.AS_OF, order_by: str = "ingest_seq") -> DataFrame:
    """Clean customers, one row per id: the first in ``order_by``.

    The median bill is taken over all rows, repeated ids included.
    """
    clean = impute(bronze, medians=("Monthly_Bill",))
    return customer_rows(keep_first(clean, "Customer_ID", order_by).drop(order_by, *_TECHNICAL), as_of)


def silver_tickets(bronze: DataFrame) -> DataFrame:
    return ticket_rows(
        impute(
            bronze,
            means=tuple(existing(bronze, ["Signal_Strength_dBm", "Buffering_Events"])),
            medians=tuple(existing(bronze, ["Customer_Satisfaction_Rating"])),
        )
    )


def silver_logs(bronze: DataFrame) -> DataFrame:
    return log_rows(
        impute(bronze, means=tuple(existing(bronze, ["Buffering_Events"])), medians=tuple(existing(bronze, ["User_Rating"])))
    )
