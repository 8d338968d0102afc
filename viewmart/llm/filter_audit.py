"""How filters interact: what each removes, alone and after others, in every order that they may run.

1. One pass over the texts gives each document a mask of the filters that it fails.
2. Documents are counted by part and mask, so a part has at most 2 ** filters cells.
3. Each cell is folded along every order in a fixed array of orders (``transform`` over the orders,
   ``aggregate`` over the filters of one), which yields a weighted struct per order and step; the
   structs of a part's cells are added up element by element.

All of it is built-in expressions. Only narrow rows are shuffled, never a text.
"""

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from viewmart.llm.common import SPACES, settle, words_of

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Conditions under which a text fails: A few words, B repeated words, C capitals, D symbols."""
    distinct = F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {
        "A": F.size(words) < 50,
        "B": 100 * distinct < 65 * F.size(words).cast("long"),
        "C": 100 * capitals > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(fails: Mapping[str, Column], letters: str) -> Column:
    total = F.lit(0)
    for letter, failed in fails.items():
        total = total + F.when(failed, 1 << letters.index(letter)).otherwise(0)
    return total


def masks(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters that they fail.

    The last letter stands for a copy: a text that a document with a smaller id holds too.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.withColumn("words", words_of(F.col("text")))
    # Without an id a row is no copy, has no copies and no labels; then one digest serves all.
    digest = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256))), F.lit(b""))
    fails = text_filters(F.col("text"), F.col("words"))
    # Written once, so that the texts are read once.
    read = settle(cut.select("doc_id", "part", _mask(fails, letters).alias("mask"), digest.alias("digest")), "masks")
    # Repeated rows are combined before the first shuffle, also a hot id and all rows without one.
    rows = read.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = read.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("is_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    marked = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    marked = marked.withColumn("mask", F.col("mask") + F.when(copy, 1 << (len(letters) - 1)).otherwise(0))
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def _folded(cell: Column, orders: Column) -> Column:
    """An array of weighted structs, one per order and step, for one cell (mask, n, good, toxic)."""
    mask, nothing = cell["mask"], F.lit(0).cast("long")

    def weigh(condition: Column, weight: Column) -> Column:
        return F.when(condition, weight).otherwise(nothing)

    def step(done: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        alive, removed = done["alive"], done["alive"] & fails
        counts = F.struct(
            weigh(alive & ~fails, cell["n"]).alias("kept"),
            weigh(removed, cell["n"]).alias("removed"),
            weigh(~alive & fails, cell["n"]).alias("redundant"),
            weigh(mask == bit, cell["n"]).alias("unique_fails"),
            weigh(removed, cell["good"]).alias("good_lost"),
            weigh(removed, cell["toxic"]).alias("toxic_lost"),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(done["steps"], F.array(counts)).alias("steps"))

    none = "array<struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(none).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda done: done["steps"])))


def filter_interactions(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, counts, shapley) from (part, mask, n, good, toxic), zeros included.

    The cells of a part are at most 2 ** len(letters), so a part's fold is one bounded row.
    """
    named = ["".join(order) for order in permutations(letters)]
    steps = len(letters)
    orders = F.lit([[1 << letters.index(letter) for letter in order] for order in named])

    def added(total: Column, other: Column) -> Column:
        return F.zip_with(total, other, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS]))

    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    zeros = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    total = F.aggregate("cells", F.array_repeat(zeros, len(named) * steps), lambda total, cell: added(total, _folded(cell, orders)))
    places = F.lit([letters.index(letter) for order in named for letter in order])
    removed = F.zip_with("total", places, lambda c, place: F.struct(place.alias("place"), c["removed"].alias("n")))

    def of_filter(place: int) -> Column:
        return F.aggregate("removed", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(c["place"] == place, c["n"]).otherwise(0))

    summed = packed.select("part", total.alias("total")).withColumn("removed", removed)
    summed = summed.select("part", "total", F.array(*[of_filter(i) for i in range(steps)]).alias("shapley"))
    rows = summed.select("part", "shapley", F.posexplode("total").alias("place", "c"))
    return rows.select(
        "part",
        F.get(F.lit(named), F.floor(F.col("place") / steps).cast("int")).alias("filter_order"),
        (F.col("place") % steps + 1).alias("step"),
        "c.*",
        F.get("shapley", F.get(places, F.col("place"))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic).

    One row for each part (a NULL source is the empty part), order and step. NULL text is empty:
    it fails A, and E beside another empty text. A row without an id is no copy and makes no other
    one a copy; rows that repeat an id are counted each, and copies of one id's own text are none
    of E's. An id is good or toxic if any of its labels says so; NULL labels say nothing. Rows
    without labels are neither. Further columns are ignored; without documents there are no parts.
    """
    docs = docs.select("doc_id", "text", "source")
    return filter_interactions(masks(docs, labels.select("doc_id", "quality", "toxic")))


def filter_audit_sql() -> str:
    """The same as DuckDB SQL over ``documents`` and ``labels``, one document and order at a time."""
    spaces = SPACES.replace("'", "''")
    return rf"""
    WITH read AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^{spaces}]+') AS words
      FROM documents),
    first AS (SELECT text, min(doc_id) AS first_id FROM read GROUP BY text),
    judged AS (
      SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d, coalesce(first_id < doc_id, false) AS e
      FROM read JOIN first USING (text)),
    fails AS (
      SELECT j.*, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
        CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
          || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed
      FROM judged j LEFT JOIN (
        SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
        FROM labels GROUP BY doc_id) l USING (doc_id)),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
      FROM letter a, letter b, letter c, letter d, letter e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (
      SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier
      FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    seen AS (
      SELECT s.*, r.part, r.good, r.toxic, r.failed, contains(r.failed, s.f) AS now,
        len(list_intersect(string_split(r.failed, ''), string_split(s.earlier, ''))) > 0 AND s.earlier <> '' AND r.failed <> '' AS before
      FROM fails r, steps s),
    counted AS (
      SELECT part, filter_order, step, f,
        count(*) FILTER (NOT before AND NOT now) AS kept, count(*) FILTER (NOT before AND now) AS removed,
        count(*) FILTER (before AND now) AS redundant, count(*) FILTER (failed = f) AS unique_fails,
        count(*) FILTER (NOT before AND now AND good) AS good_lost, count(*) FILTER (NOT before AND now AND toxic) AS toxic_lost
      FROM seen GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
    FROM counted"""
