"""Bronze schemas as StructTypes."""

from pyspark.sql.types import StructType

from viewmart import fixed_values as fv

BRONZE_COLUMNS = {
    "customers": fv.CUSTOMER_COLUMNS,
    "tickets": fv.TICKET_COLUMNS,
    "viewing_logs": fv.LOG_COLUMNS,
}


def bronze_schema(table: str) -> StructType:
    return StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in BRONZE_COLUMNS[table]))


def bronze_names(table: str) -> list[str]:
    return [name for name, _ in BRONZE_COLUMNS[table]]
