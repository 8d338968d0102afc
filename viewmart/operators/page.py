"""All distributions of a dashboard page in one scan."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

Measures = Mapping[str, Column]


def bin_of(column: str, bins: int, low: float, high: float) -> Column:
    """The number of the equal-width bin, the outer ones open; NULL for NULL."""
    place = F.floor((F.col(column) - F.lit(float(low))) / F.lit((high - low) / bins))
    return F.when(F.col(column).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int"))


def page(df: DataFrame, totals: Measures, panels: Mapping[str, tuple[Column, Measures]]) -> DataFrame:
    """(Panel, Item, Measure, Value): the measures of the whole table (panel ``total``) and of each panel's groups.

    A panel is a key and its measures. Every panel is one grouping set of a single aggregate, so the table is read
    once and a task sends one row for each group of each panel. Rows whose key is NULL are in no group of
    its panel, but count elsewhere. A table without rows gives none, not even for ``total``. Values are doubles.
    """
    keys = [f"_key{i}" for i in range(len(panels))]
    keyed = df.withColumns({key: column.cast("string") for key, (column, _) in zip(keys, panels.values(), strict=True)})
    sets = [("total", None, totals), *[(name, key, measures) for key, (name, (_, measures)) in zip(keys, panels.items(), strict=True)]]
    every = (1 << len(keys)) - 1
    own = [0 if key is None else 1 << (len(keys) - 1 - keys.index(key)) for _, key, _ in sets]
    aggregates = [measure.alias(f"_m{i}_{j}") for i, (_, _, ms) in enumerate(sets) for j, measure in enumerate(ms.values())]
    grouped = keyed.groupingSets([[F.col(key)] if key else [] for _, key, _ in sets], *[F.col(key) for key in keys])
    rows = grouped.agg(F.grouping_id().alias("_set"), *aggregates)
    parts = None
    for i, (name, key, measures) in enumerate(sets):
        item = F.col(key) if key else F.lit(None).cast("string")
        values = F.array(
            *[
                F.struct(F.lit(name).alias("Panel"), item.alias("Item"), F.lit(measure).alias("Measure"), F.col(f"_m{i}_{j}").cast("double").alias("Value"))
                for j, measure in enumerate(measures)
            ]
        )
        here = F.col("_set") == every - own[i]
        here = here & F.col(key).isNotNull() if key else here
        parts = F.when(here, values) if parts is None else parts.when(here, values)
    return rows.select(F.inline(parts))
