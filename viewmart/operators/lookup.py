"""Left join of a large table to a per-key lookup table."""

from pyspark.sql import DataFrame


def attach_lookup(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Add the columns of ``lookup`` (one row per key) to ``facts``; no match gives NULL.

    A plain left join at every size. ``lookup`` comes from a settled table, so Spark knows its
    true size and broadcasts it when small; otherwise the adaptive join splits hot keys of the
    facts. A NULL key matches nothing.
    """
    columns = [name for name in lookup.columns if name != key]
    return facts.join(lookup, key, "left").select(*facts.columns, *columns)
