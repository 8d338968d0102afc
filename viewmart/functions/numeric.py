"""Numeric expressions."""

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def clip(value: Column, low: float = 0, high: float = 100) -> Column:
    """Limit to [low, high]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    value = value.cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def truncate(value: Column) -> Column:
    """Whole part, toward zero."""
    return value.cast("int")


def score(value: Column) -> Column:
    """Truncated score; 0 where the inputs define none (for example a zero divisor)."""
    return F.coalesce(truncate(value), F.lit(0))


#: Fractions add up to six digits, so sums do not depend on the order of the rows.
EXACT = "decimal(28,6)"


def exact(value: Column) -> Column:
    """The value to six digits as a decimal, for sums that know no order.

    Doubles that are added up in another order differ in their last bits, which a comparison or a
    truncated score turns into another result. NaN, the infinities and 1e22 or more become NULL.
    """
    return value.try_cast(EXACT)


def exact_avg(value: Column | str) -> Column:
    """The mean of the values that are not NULL, the same in any order of the rows."""
    taken = exact(F.col(value) if isinstance(value, str) else value)
    return F.try_divide(F.sum(taken).cast("double"), F.count(taken))


def ladder(steps: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """The label of the first condition that holds; a NULL condition does not hold."""
    chain = F
    for condition, label in steps:
        chain = chain.when(condition, label)
    return chain.otherwise(otherwise)


def bands(value: Column, edges: list[tuple[float, float | None, str]], closed: str) -> Column:
    """Label of the interval holding ``value``, NULL outside all; ``closed`` is left or right."""
    steps = []
    for low, high, label in edges:
        if closed == "left":
            inside = value >= low if high is None else (value >= low) & (value < high)
        else:
            inside = value > low if high is None else (value > low) & (value <= high)
        steps.append((inside, label))
    return ladder(steps, None)
