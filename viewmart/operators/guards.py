"""Plan-time checks on which columns a table has."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def has(df: DataFrame, *names: str) -> bool:
    return all(name in df.columns for name in names)


def any_of(df: DataFrame, name: str, build: Callable[[Column], Column], default: object) -> Column:
    """``build(column)`` when the table has the column, else the constant ``default``."""
    return build(F.col(name)) if has(df, name) else F.lit(default)


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [name for name in names if has(df, name)]


def unique_names(names: Sequence[str]) -> list[str]:
    """The names without repeats, first place kept."""
    return list(dict.fromkeys(names))


def where_in(df: DataFrame, optional: Sequence[str] = (), **choices: Sequence | None) -> DataFrame:
    """Keep rows whose column is among the chosen values; no choice means no filter.

    None among the values chooses NULL. A choice on a column that the table lacks is an error,
    unless the column is ``optional``.
    """
    for name, values in choices.items():
        if not values or (name in optional and not has(df, name)):
            continue
        if not has(df, name):
            raise ValueError(f"there is no column {name} to choose from")
        wanted = F.col(name).isin([value for value in values if value is not None])
        df = df.where(wanted | F.col(name).isNull() if None in values else wanted)
    return df
