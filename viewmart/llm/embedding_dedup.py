"""Embedding near-duplicates by sorted projection passes.

Each pass sorts the vectors of a label, centred by the label's mean, by the signs of their products
with random directions, one after another, so that close vectors tend to stand close. Every vector is
compared with a bounded window of those after it, and verified pairs of all passes are united.

How many passes a label needs is measured, not assumed: the first passes count for each row how many
signs it shares with the row a window further on, and its distance from the mean tells how often
a pair at the threshold agrees in a sign. Where so many passes would compare more pairs than
the label has, as in a narrow cone, the label is compared block against block instead. Links are then
counted exactly inside the components that were found.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viewmart.llm.common import settle, ship
from viewmart.llm.components import components
from viewmart.llm.simhash import roots, unite

KEY_BITS = 62
BLOCK = 2048
#: Passes that every label with more rows than a window gets, and by which the others are reckoned.
FIRST_PASSES = 2
#: Steps of the stored -log2 of the probability that a pass finds a pair: a power of 2 ** (1 / STEPS).
STEPS = 4


def matrix_of(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to the longest; none may be zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = flat
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def directions(number: int, width: int) -> np.ndarray:
    """KEY_BITS random directions of a pass; the first coordinates do not depend on the width."""
    columns = [np.random.default_rng([number, place]).standard_normal(KEY_BITS) for place in range(width)]
    return np.array(columns).reshape(width, KEY_BITS)


def label_means(classes: DataFrame) -> DataFrame:
    """A row for each label and width: group (a number), rows, centre (mean unit vector, six digits)."""
    kind = classes.schema["label"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = matrix_of(batch.column("embedding"))
            marks = pa.Table.from_batches([batch.select(["label", "width"])]).append_column("at", pa.array(np.arange(len(units))))
            groups = marks.group_by(["label", "width"]).aggregate([("at", "list"), ("at", "count")])
            centres = [units[at, :width].sum(axis=0) for at, width in zip(groups["at_list"].to_pylist(), groups["width"].to_pylist(), strict=True)]
            columns = [groups[name].combine_chunks() for name in ("label", "width", "at_count")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(centres, pa.list_(pa.float64()))], ["label", "width", "rows", "sums"])

    part = classes.select("label", "width", "embedding").mapInArrow(sums, f"label {kind}, width int, rows long, sums array<double>")
    places = part.select("label", "width", "rows", F.posexplode("sums").alias("place", "part"))
    means = places.groupBy("label", "width", "place").agg(F.sum("rows").alias("rows"), F.round(F.sum("part") / F.sum("rows"), 6).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "mean")))
    whole = means.groupBy("label", "width").agg(F.max("rows").alias("rows"), F.transform(ordered, lambda x: x["mean"]).alias("centre"))
    return settle(whole.withColumn("group", F.monotonically_increasing_id()), "vector-labels")


def sort_keys(rows: DataFrame, min_cosine: float) -> DataFrame:
    """A row for each pass from ``first`` to before ``last``: (turn, group, sign_key, vec_id, class, loss, embedding).

    ``loss`` is -log2 of the probability that a pair at the threshold agrees in one sign.
    """
    names = ["turn", "group", "sign_key", "vec_id", "class", "loss", "embedding"]
    weights = np.int64(1) << np.arange(KEY_BITS, dtype=np.int64)[::-1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = matrix_of(batch.column("embedding"))
            sizes = batch.column("width").to_numpy()
            moved = units.copy()
            moved[np.arange(units.shape[1]) < sizes[:, None]] -= batch.column("centre").flatten().to_numpy()
            spread = np.einsum("ij,ij->i", moved, moved)
            cosine = 1 - (1 - min_cosine) / np.maximum(spread, 1e-12)
            # Two rows on opposite sides of the mean agree no less often than by chance.
            loss = -np.log2(np.maximum(0.5, 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi))
            first, last = batch.column("first").to_numpy(), batch.column("last").to_numpy()
            for turn in range(int(first.min()), int(last.max())):
                at = np.flatnonzero((first <= turn) & (turn < last))
                keys = ((moved[at] @ directions(turn, units.shape[1])) > 0) @ weights
                part = batch.take(pa.array(at))
                own = [pa.array(np.full(len(at), turn), pa.int32()), part.column("group"), pa.array(keys, pa.int64())]
                own += [part.column("vec_id"), part.column("class"), pa.array(loss[at]), part.column("embedding")]
                yield pa.RecordBatch.from_arrays(own, names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"turn int, group long, sign_key long, vec_id {kinds['vec_id']}, class string, loss double, embedding {kinds['embedding']}"
    return rows.select("group", "width", "vec_id", "class", "centre", "first", "last", "embedding").mapInArrow(project, schema)


def neighbours(units: np.ndarray, run: np.ndarray, window: int, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs (a, b), a < b, of equal run: every one within ``window`` places, and some up to twice that."""
    at = np.arange(0, len(units), window)
    for start in at.tolist():
        head, near = slice(start, start + window), slice(start, start + 2 * window)
        hit = (units[head] @ units[near].T >= min_cosine) & (run[head, None] == run[near])
        a, b = np.nonzero(np.triu(hit, 1))
        yield a + start, b + start


def window_links(keyed: DataFrame, min_cosine: float, window: int) -> DataFrame:
    """Rows of two kinds: (a, b) that span the verified pairs, and (group, cost, rows) that tell how sure they are.

    ``cost`` is -log2 of the probability that this pass finds a pair of a row at the threshold, in STEPS; each
    row adds one to ``rows``. Windows end with the partition: a row whose window is cut short there
    counts as found half as often.
    """
    kind = keyed.schema["vec_id"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, group long, cost int, rows long"

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compared(table: pa.Table, done: int, more: bool) -> Iterator[pa.RecordBatch]:
            """Pairs of all rows, and the costs of rows from ``done`` on whose window is known or ends here."""
            units = matrix_of(table["embedding"].combine_chunks())
            turn, group = table["turn"].to_numpy(), table["group"].to_numpy()
            key, loss = table["sign_key"].to_numpy(), table["loss"].to_numpy()
            n = len(units)
            run = np.cumsum(np.r_[0, (turn[1:] != turn[:-1]) | (group[1:] != group[:-1])])
            parent = np.arange(n)
            for a, b in neighbours(units, run, window, min_cosine):
                unite(parent, a, b)
            top = roots(parent, np.arange(n))
            moved = np.flatnonzero(top != np.arange(n))
            ids = table["vec_id"].combine_chunks()
            a, b = ids.take(pa.array(moved)), ids.take(pa.array(top[moved]))
            rows = np.arange(done, n - window if more else n)
            far = np.minimum(rows + window, n - 1)
            shared = KEY_BITS - np.frexp((key[rows] ^ key[far]).astype(np.float64))[1]
            needed = np.where(run[rows] == run[far], np.minimum(shared + 1, KEY_BITS), 0)
            cut = (rows + window > n - 1) & (run[rows] == run[-1])
            cost = np.ceil(STEPS * np.where(cut, loss[rows] * needed + 1, loss[rows] * needed)).astype(np.int64)
            seen, count = np.unique(np.stack([group[rows], cost]), axis=1, return_counts=True)
            empty, other = pa.nulls(len(moved), pa.int64()), pa.nulls(len(count), ids.type)
            yield pa.RecordBatch.from_arrays([a, b, empty, empty.cast(pa.int32()), empty], ["a", "b", "group", "cost", "rows"])
            measured = [other, other, pa.array(seen[0]), pa.array(seen[1].astype(np.int32)), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(measured, ["a", "b", "group", "cost", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [*(held.to_batches() if held else []), batch]
            held = pa.Table.from_batches(parts).combine_chunks()
            if held.num_rows > 4 * window:
                yield from compared(held, 0, True)
                # Their windows are still to be filled up by the next batch.
                held = held.slice(held.num_rows - window)
        if held is not None:
            yield from compared(held, 0, False)

    order = ["turn", "group", "sign_key", "vec_id", "class"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(dealt.mapInArrow(links, schema), "vector-links")


def passes_by_label(measured: DataFrame, labels: DataFrame, window: int, miss: float) -> DataFrame:
    """(group, last): how many passes a label gets; NULL where comparing all its rows is less work.

    ``last`` is the smallest step of a geometric sequence of passes after which a pair of a row of
    the label is missed with probability ``miss`` or less, on the average of its rows.
    """
    costs = measured.where("rows is not null").groupBy("group", "cost").agg(F.sum("rows").alias("rows"))
    most = labels.where(F.col("rows") > window).select("group", (F.col("rows") / (2 * window)).alias("most"))
    ladder = F.sequence(F.lit(0), F.ceil(4 * F.log2(F.greatest("most", F.lit(1.0)) + 1)).cast("int"))
    tried = F.transform(ladder, lambda k: F.ceil(FIRST_PASSES * F.pow(F.lit(2.0), k / 4)).cast("int"))
    missed = F.pow(1 - F.pow(F.lit(2.0), -F.col("cost") / STEPS), F.col("last"))
    judged = (
        costs.join(most, "group")
        .withColumn("last", F.explode(F.array_distinct(tried)))
        .groupBy("group", "most", "last")
        .agg((F.sum(F.col("rows") * missed) / F.sum("rows")).alias("missed"))
    )
    enough = (F.col("missed") <= miss) & (F.col("last") < F.greatest("most", F.lit(float(FIRST_PASSES + 1))))
    return judged.groupBy("group").agg(F.min(F.when(enough, F.col("last"))).alias("last"))


def block_links(rows: DataFrame, min_cosine: float) -> DataFrame:
    """(a, b) that span all links of each group, whose blocks are compared pair by pair."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def linked(part: pa.Table, near: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        parent = np.arange(part.num_rows)
        a, b = np.nonzero(near)
        unite(parent, first[a], second[b])
        top = roots(parent, np.arange(part.num_rows))
        moved = np.flatnonzero(top != np.arange(part.num_rows))
        ids = part["vec_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(top[moved]))], ["a", "b"])

    return block_pairs(rows, "group", ["vec_id"], min_cosine, linked, f"a {kind}, b {kind}")


def block_pairs(
    rows: DataFrame,
    group: str,
    carry: list[str],
    min_cosine: float,
    work: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """What ``work`` makes of each pair of blocks of each group of ``size`` rows.

    Groups are cut into blocks by a hash of the row; each pair of blocks is one bounded group of rows. ``work``
    gets its rows, which of the first block are near which of the second, and where both stand.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec_id", "embedding"), blocks).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select(
        F.col(group).alias("part"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *carry, "embedding"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
            marks = np.stack([table[name].to_numpy() for name in ("part", "low", "high")])
            edges = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0), True])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                units = matrix_of(part["embedding"].combine_chunks())
                side = part["own"].to_numpy()
                low, high = part["low"][0].as_py(), part["high"][0].as_py()
                first, second = np.flatnonzero(side == low), np.flatnonzero(side == high)
                yield work(part, units[first] @ units[second].T >= min_cosine, first, second)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*[x for t in held for x in t.to_batches()], batch]).combine_chunks()
            marks = np.stack([table[name].to_numpy() for name in ("part", "low", "high")])
            cut = int(np.flatnonzero((marks != marks[:, -1:]).any(axis=0))[-1]) + 1 if (marks != marks[:, -1:]).any() else 0
            if cut:
                yield from compared(table.slice(0, cut))
            held = [table.slice(cut)]
        for table in held:
            yield from compared(table)

    order = ["part", "low", "high"]
    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, schema)


def count_links(members: DataFrame, min_cosine: float) -> DataFrame:
    """(class, linked): the weight of the rows of each component that link with a row, itself included."""

    def counted(part: pa.Table, near: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        weight = part["weight"].to_numpy().astype(np.float64)
        linked = np.zeros(part.num_rows)
        linked[first] += near @ weight[second]
        if part["low"][0].as_py() != part["high"][0].as_py():
            linked[second] += weight[first] @ near
        return pa.RecordBatch.from_arrays(
            [part["class"].combine_chunks(), pa.array(np.rint(linked).astype(np.int64))], ["class", "linked"]
        )

    pairs = block_pairs(members, "component", ["class", "weight"], min_cosine, counted, "class string, linked long")
    return pairs.groupBy("class").agg(F.sum("linked").alias("linked"))


def embedding_dedup(
    vectors: DataFrame,
    min_cosine: float = 0.93,
    window: int = 64,
    miss: float = 1e-4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id that links reach), kept.

    Two rows link if their labels are equal, their vectors have equal length, and the cosine in
    double precision is at least ``min_cosine`` (over 0). Rows with a NULL id, label or vector,
    with a NULL or non-finite component, or with all zeros, link with nothing; a NULL id has no
    component and is not kept. Rows with equal vectors are compared as one and counted apart.
    Rows that repeat an id with other vectors share a component. Ids are integers. Every link
    within a component that was found is counted; ``miss`` bounds the probability, as measured on
    the rows of its label, that the passes miss a pair at the threshold. Labels of no more
    rows than a window, and those that need so many passes that all pairs are less work, are compared
    exactly. An empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    digest = F.concat_ws("-", F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64(F.lit("second"), "embedding", "label")))
    rows = rows.withColumn("class", F.when(F.coalesce(usable, F.lit(False)), digest))

    classes = rows.where("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = settle(classes.withColumn("width", F.size("embedding")), "vector-classes")
    labels = label_means(classes)
    rows_of = classes.join(labels, ["label", "width"])
    first_passes = rows_of.withColumns({"first": F.lit(0), "last": F.when(F.col("rows") > window, FIRST_PASSES).otherwise(1)})
    early = window_links(sort_keys(first_passes, min_cosine), min_cosine, window)
    passes = settle(passes_by_label(early, labels, window, miss), "vector-passes")
    more = rows_of.join(passes, "group").withColumn("first", F.lit(FIRST_PASSES))
    late = window_links(sort_keys(more.where(F.col("last") > FIRST_PASSES), min_cosine), min_cosine, window)
    whole = block_links(more.where("last is null").withColumn("size", F.col("rows")), min_cosine)
    links = early.select("a", "b").union(late.select("a", "b")).where("a is not null").union(whole)
    found = components(links.distinct())

    grouped = settle(classes.join(found, classes["vec_id"] == found["node"]).drop("node"), "vector-groups")
    sizes = grouped.groupBy("component").agg(F.count("*").alias("size"))
    linked = count_links(grouped.join(sizes, "component"), min_cosine)
    reach = grouped.select("class", "component").join(linked, "class", "left")
    result = (
        classes.select("class", "vec_id", "weight")
        .join(reach, "class", "left")
        # A row of a component is counted as linked with itself.
        .select(
            "class",
            (F.coalesce("linked", "weight") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    joined = rows.select("vec_id", "class").join(result, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
