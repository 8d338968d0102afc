"""Data-quality audits of bronze tables."""

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from viewmart.fixed_values import AS_OF, MAX_VIEW_MINUTES
from viewmart.operators import existing, spelling_clusters


def _stack(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _long(df: DataFrame, measures: dict[str, Column], name: str, value: str) -> DataFrame:
    """One aggregate per measure in a single pass, one output row each."""
    row = df.agg(*[measure.alias(label) for label, measure in measures.items()])
    return row.unpivot([], list(measures), name, value)


def null_rates(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for table, df in tables.items():
        rates = {name: F.expr(f"try_divide(count(*) - count(`{name}`), count(*))") for name in df.columns}
        parts.append(_long(df, rates, "Column_Name", "Null_Rate").select(F.lit(table).alias("Table_Name"), "*"))
    return _stack(parts)


def duplicate_customers(customers: DataFrame) -> DataFrame:
    """Repeated ids, and whether their copies disagree on name or bill.

    Smallest against largest needs one value per key and task, where counting distinct
    values would ship each of them.
    """

    def differ(name: str) -> Column:
        mixed = F.min(name) != F.max(name)
        partly_missing = (F.count(name) > 0) & (F.count(name) < F.count("*"))
        return F.coalesce(mixed, F.lit(False)) | partly_missing

    return (
        customers.groupBy("Customer_ID")
        .agg(
            F.count("*").alias("Copies"),
            differ("Name").alias("Names_Differ"),
            differ("Monthly_Bill").alias("Bills_Differ"),
        )
        .where(F.col("Copies") > 1)
    )


def future_dates(customers: DataFrame, as_of: date = AS_OF) -> DataFrame:
    return customers.agg(
        F.count("*").alias("Row_Count"), F.count_if(F.col("Join_Date") > F.lit(as_of)).alias("Future_Join_Dates")
    )


def outliers(
    customers: DataFrame, logs: DataFrame, max_bill: float = 1000.0, max_minutes: int = MAX_VIEW_MINUTES
) -> DataFrame:
    """Values above a limit, with the largest; cleaning caps view minutes but not bills."""

    def above(df: DataFrame, table: str, name: str, limit: float) -> DataFrame:
        value = F.col(name).cast("double")
        return df.agg(
            F.lit(table).alias("Table_Name"),
            F.lit(name).alias("Column_Name"),
            F.count_if(value > limit).alias("Outliers"),
            F.max(value).alias("Largest"),
        )

    return above(customers, "customers", "Monthly_Bill", max_bill).unionByName(
        above(logs, "viewing_logs", "View_Duration_Mins", max_minutes)
    )


def category_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(Table_Name, Column_Name, Value, Row_Count) for the values that are not NULL.

    Each table is read once, and only counted distinct pairs leave the map side.
    """
    parts = []
    for table, (df, names) in tables.items():
        pairs = F.explode(
            F.array(*[F.struct(F.lit(name).alias("Column_Name"), F.col(name).alias("Value")) for name in existing(df, names)])
        )
        values = df.select(F.lit(table).alias("Table_Name"), pairs.alias("pair")).select("Table_Name", "pair.*")
        values = values.where(F.col("Value").isNotNull())
        parts.append(values.groupBy("Table_Name", "Column_Name", "Value").agg(F.count("*").alias("Row_Count")))
    return _stack(parts)


def category_variants(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Spellings per column, and how many remain once letter case is ignored.

    Each table is read once: its columns are unfolded to (column, value) pairs and counted,
    which keeps only distinct pairs after the map side.
    """
    parts = []
    for table, (df, names) in tables.items():
        pairs = F.explode(
            F.array(*[F.struct(F.lit(name).alias("Column_Name"), F.col(name).alias("Value")) for name in existing(df, names)])
        )
        values = df.select(pairs.alias("pair")).select("pair.*").where(F.col("Value").isNotNull()).distinct()
        parts.append(
            values.groupBy(F.lit(table).alias("Table_Name"), "Column_Name").agg(
                F.count("*").alias("Spellings"), F.count_distinct(F.lower("Value")).alias("Categories")
            )
        )
    return _stack(parts)


def spelling_classes(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Each spelling of each column with its number of rows and the class that it belongs to."""
    return spelling_clusters(category_counts(tables), ["Table_Name", "Column_Name"])


def negative_durations(tickets: DataFrame, logs: DataFrame) -> DataFrame:
    def backwards(df: DataFrame, table: str, start: str, end: str) -> DataFrame:
        return df.agg(
            F.lit(table).alias("Table_Name"),
            F.count("*").alias("Row_Count"),
            F.count_if(F.col(end) < F.col(start)).alias("Negative_Durations"),
        )

    return backwards(tickets, "tickets", "Created_Date", "Resolved_Date").unionByName(
        backwards(logs, "viewing_logs", "Start_Time", "End_Time")
    )


def orphans(customers: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Fact rows whose customer is unknown, per table and id.

    The facts are counted per id before the anti join, so a hot id is one row in it.
    """
    known = customers.select("Customer_ID").where(F.col("Customer_ID").isNotNull()).distinct()
    parts = []
    for table, df in facts.items():
        counts = df.groupBy("Customer_ID").agg(F.count("*").alias("Orphan_Rows"))
        lost = counts.join(known, "Customer_ID", "left_anti")
        parts.append(lost.select(F.lit(table).alias("Table_Name"), "Customer_ID", "Orphan_Rows"))
    return _stack(parts)
