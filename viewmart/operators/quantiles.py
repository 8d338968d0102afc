"""Exact quantiles of a column, found the same way at every size, as a plan or at once.

``percentile`` gathers every distinct value in one task. Here the wanted ranks are narrowed
down in three counting passes, each a map-side combined ``groupBy`` with a bounded number of
groups:

1. logarithmic cells over the whole number line (at most 1.6 million, a few thousand in use;
   either infinity has a cell of its own),
2. 2**20 even slices of the cells that hold a wanted rank,
3. the distinct values of the slices that hold one (a slice spans so little that fewer than
   2**24 distinct doubles fit).

Both codes only ever grow with the value, so counting groups in order gives exact ranks.

``exact_quantiles`` is one plan that runs nothing until it is used. ``quantile_values`` runs the passes at
once and stops as soon as each wanted rank stands in a group of a single value, which ratings and
counts mostly do after the first pass and amounts after the second.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

_CELLS_PER_E = 1024
_CELL_OFFSET = 800_000  # ln of the smallest double is -745; keeps codes of |v| above zero
_SLICES = 1 << 20
_INFINITE = 2_000_000


def _cell(value: Column) -> Column:
    finite = F.floor(F.log(F.abs(value)) * _CELLS_PER_E).cast("long") + _CELL_OFFSET
    size = F.when(F.abs(value) == float("inf"), F.lit(_INFINITE).cast("long")).otherwise(finite)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def _cell_limits(cell: Column) -> tuple[Column, Column]:
    step = F.abs(cell) - _CELL_OFFSET
    return F.exp(step / _CELLS_PER_E), F.exp((step + 1) / _CELLS_PER_E)


def _slice() -> Column:
    depth = F.try_divide(F.abs("value") - F.col("low"), F.col("high") - F.col("low"))
    place = F.when(F.abs("cell") == _INFINITE, 0).otherwise(F.floor(F.coalesce(depth, F.lit(0.0)) * _SLICES))
    return F.when(F.col("value") > 0, place).when(F.col("value") < 0, -place).otherwise(0).cast("long")


def _narrow(groups: DataFrame, wanted: DataFrame, known: list[str], code: str) -> DataFrame:
    """One more pass: which ``code`` within the ``known`` ones holds each wanted rank."""
    counts = groups.groupBy(*known, code).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*known).orderBy(code))
    held = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    return (
        counts.withColumn("upto", upto)
        .join(F.broadcast(wanted), known)
        .where(held)
        .select("want", "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), *known, code)
    )


def exact_quantiles(df: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """One row with an exact, linearly interpolated quantile per entry of ``fractions``.

    NULL and NaN are skipped; the quantiles of no values are NULL. The column is read three
    times, by one plan: what a pass has found is broadcast to the next (two ranks a fraction).
    """
    values = df.select(F.col(column).cast("double").alias("value"))
    values = values.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("cell", _cell(F.col("value")))
    # The windows without a key run over the cell counts only, never over the rows.
    cells = values.groupBy("cell").agg(F.count("*").alias("n")).withColumns(
        {
            "upto": F.sum("n").over(Window.orderBy("cell")),
            "total": F.sum("n").over(Window.partitionBy()),
        }
    )
    wants = []
    for i, fraction in enumerate(fractions.values()):
        position = F.lit(float(fraction)) * (F.col("total") - 1)
        for side, place in enumerate((F.floor(position), F.ceil(position))):
            wants.append(
                F.struct(
                    F.lit(2 * i + side).alias("want"),
                    (position - F.floor(position)).alias("part"),
                    place.cast("long").alias("rank"),
                )
            )
    in_cells = (
        cells.select("cell", "n", "upto", F.explode(F.array(*wants)).alias("w"))
        .select("cell", "n", "upto", "w.*")
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select("want", "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "cell")
    )
    low, high = _cell_limits(F.col("cell"))
    targets = in_cells.select("cell").distinct().select("cell", low.alias("low"), high.alias("high"))
    sliced = values.join(F.broadcast(targets), "cell").select("value", "cell", _slice().alias("slice"))
    in_slices = _narrow(sliced, in_cells, ["cell"], "slice")

    held = F.broadcast(in_slices.select("cell", "slice").distinct())
    found = _narrow(sliced.join(held, ["cell", "slice"], "left_semi"), in_slices, ["cell", "slice"], "value")

    def pick(want: int, name: str) -> Column:
        return F.max(F.when(F.col("want") == want, F.col(name)))

    picked = []
    for i, name in enumerate(fractions):
        low, high, part = pick(2 * i, "value"), pick(2 * i + 1, "value"), pick(2 * i, "part")
        between = (F.lit(1.0) - part) * low + part * high
        picked.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.agg(*picked)


def _held(groups: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Groups with the number of values up to each, and in all, within ``keys``."""
    # Without keys the windows run over the counts of cells only, never over the rows.
    part = Window.partitionBy(*keys)
    return groups.withColumns({"upto": F.sum("n").over(part.orderBy(code)), "total": F.sum("n").over(part)})


def quantile_values(
    df: DataFrame, column: str, fractions: dict[str, float], weight: str | None = None
) -> dict[str, float | None]:
    """An exact, linearly interpolated quantile per entry of ``fractions``.

    ``weight`` names a column that tells how many rows each row stands for.

    NULL and NaN are skipped; the quantiles of no values are None. Each pass runs when this is called and
    brings at most two rows a fraction to the driver.
    """
    number = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    values = df.select(F.col(column).cast("double").alias("value"), number.alias("number"))
    values = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = [F.sum("number").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
    cells = _held(values.groupBy(_cell(F.col("value")).alias("cell")).agg(*counted), [], "cell")
    places = [F.floor(F.lit(float(f)) * (F.col("total") - 1)) for f in fractions.values()]
    places += [F.ceil(F.lit(float(f)) * (F.col("total") - 1)) for f in fractions.values()]
    wants = F.array(*[F.struct(F.lit(i).alias("want"), place.cast("long").alias("rank")) for i, place in enumerate(places)])
    inside = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    rows = cells.select("*", F.explode(wants).alias("w")).select("*", "w.*").where(inside).collect()
    if not rows:
        return dict.fromkeys(fractions)
    total = rows[0]["total"]
    #: Per wanted rank: its place among the values of its group, and the group's smallest and largest.
    found = {r["want"]: (r["rank"] - (r["upto"] - r["n"]), r["low"], r["high"]) for r in rows}
    while spans := sorted({(low, high) for _, low, high in found.values() if low < high}):
        code, span = F, F
        for i, (low, high) in enumerate(spans):
            own = F.col("value").between(low, high)
            code = code.when(own, F.floor((F.col("value") - low) / F.lit(high - low) * _SLICES).cast("long"))
            span = span.when(own, i)
        sliced = values.select("value", "number", span.alias("span"), code.alias("slice")).where(F.col("span").isNotNull())
        groups = _held(sliced.groupBy("span", "slice").agg(*counted), ["span"], "slice")
        asked = {want: (spans.index((low, high)), rank) for want, (rank, low, high) in found.items() if low < high}
        wants = F.array(*[F.struct(F.lit(w).alias("want"), F.lit(s).alias("of"), F.lit(r).cast("long").alias("rank")) for w, (s, r) in asked.items()])
        rows = groups.select("*", F.explode(wants).alias("w")).select("*", "w.*").where((F.col("of") == F.col("span")) & inside).collect()
        found |= {r["want"]: (r["rank"] - (r["upto"] - r["n"]), r["low"], r["high"]) for r in rows}
    picked = {}
    for i, (name, fraction) in enumerate(fractions.items()):
        low, high = found[i][1], found[len(fractions) + i][1]
        position = float(fraction) * (total - 1)
        part = position - math.floor(position)
        picked[name] = low if low == high else (1.0 - part) * low + part * high
    return picked
