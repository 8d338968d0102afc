"""Whole-table statistics used as column operands."""

from pyspark.sql import Column, DataFrame, functions as F

from viewmart.functions.numeric import exact_avg
from viewmart.operators.quantiles import quantile_values


def with_globals(df: DataFrame, source: DataFrame, **stats: Column) -> DataFrame:
    """Add whole-table aggregates of ``source`` to every row of ``df``.

    A global aggregate is always exactly one row, which bounds the broadcast. A window with
    no partition key would instead move the table into one task.
    """
    one_row = source.agg(*[stat.alias(name) for name, stat in stats.items()])
    return df.crossJoin(F.broadcast(one_row))


def impute(df: DataFrame, means: tuple[str, ...] = (), medians: tuple[str, ...] = ()) -> DataFrame:
    """Replace NULL by the column's own mean or exact median over all rows."""
    filled = df
    if means:
        filled = with_globals(filled, df, **{f"_fill_{name}": exact_avg(name) for name in means})
    fills = {name: F.col(f"_fill_{name}") for name in means}
    fills |= {name: F.lit(quantile_values(df, name, {name: 0.5})[name]).cast("double") for name in medians}
    return filled.withColumns(
        {name: F.coalesce(F.col(name).cast("double"), fill) for name, fill in fills.items()}
    ).drop(*[f"_fill_{name}" for name in means])
