"""Classes of spellings of one category: ``Clsd``, ``closed`` and ``CLOSED``.

1. Distinct values are counted first, so copies never leave their task and a hot value is one row.
2. A value's skeleton is its letters and digits in lower case without vowels after the first letter and
   without doubled letters. Spellings of one skeleton belong together.
3. Skeletons within a bounded edit distance are found by deletion neighbourhoods: two texts that differ
   by one edit share a text with one character deleted, so a hash join on these finds every pair.
   Their lower-case forms must then be near too and hold the same digits, for ``4K`` is no slip of ``8K``.
4. Linked skeletons are joined into classes; a class is named by its most frequent spelling.

Nothing compares all pairs: a skeleton of n characters files n + 1 rows.
"""

from pyspark.sql import Column, DataFrame, functions as F

from viewmart.operators.lookup import attach_lookup
from viewmart.session import settle


def folded(value: Column) -> Column:
    """Letters and digits in lower case, of any script."""
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def skeleton(value: Column) -> Column:
    """What careless spelling seldom loses: the first letter, and consonants and digits without doubles."""
    kept = F.concat(F.substring(folded(value), 1, 1), F.regexp_replace(F.substring(folded(value), 2, 1 << 20), "[aeiou]", ""))
    return F.regexp_replace(kept, r"(\p{L})\1+", "$1")


def _deletions(text: Column) -> Column:
    """The text, and the text without each of its characters."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))


def near_skeletons(values: DataFrame, keys: list[str], min_length: int, max_share: float) -> DataFrame:
    """(keys, a, b) with a < b: skeletons that stand for spellings within the distances.

    Skeletons of at least ``min_length`` characters link at one edit (one character added, left out or
    changed) if the folded spellings that they come from hold the same digits and differ by at most
    ``max_share`` of the longer one. Of a skeleton's spellings the longest is compared, of equally long
    ones the last in text order.
    """
    bones = values.groupBy(*keys, "skeleton").agg(F.max(F.struct(F.length("folded"), "folded"))["folded"].alias("folded"))
    bones = settle(bones.where(F.length("skeleton") >= min_length), "skeletons")
    filed = bones.select(*keys, "skeleton", "folded", F.explode(_deletions(F.col("skeleton"))).alias("shared"))
    left, right = filed.withColumnsRenamed({"skeleton": "a", "folded": "x"}), filed.withColumnsRenamed({"skeleton": "b", "folded": "y"})
    pairs = left.join(right, [*keys, "shared"]).where("a < b").select(*keys, "a", "b", "x", "y").distinct()
    longer = F.greatest(F.length("x"), F.length("y"))
    digits = lambda name: F.regexp_replace(name, r"[^\p{N}]+", "")
    near = (F.levenshtein("a", "b") <= 1) & (F.levenshtein("x", "y") <= F.floor(longer * max_share)) & (digits("x") == digits("y"))
    return pairs.where(near).select(*keys, "a", "b")


def _classes(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, skeleton, class): the smallest skeleton that links reach, by repeated exchange of minima.

    A step sends each class on to the neighbours and lets every skeleton jump to the class of its class,
    so long chains take few steps. Each step is written, which keeps lineage short.
    """
    both = settle(links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "spelling-links")
    now = settle(nodes.select(*keys, "skeleton", F.col("skeleton").alias("class")), "spelling-classes")
    while True:
        offered = both.join(now.withColumnRenamed("skeleton", "b"), [*keys, "b"]).select(*keys, F.col("a").alias("skeleton"), "class")
        least = now.select(*keys, "skeleton", "class").unionByName(offered).groupBy(*keys, "skeleton").agg(F.min("class").alias("class"))
        jump = now.select(*keys, F.col("skeleton").alias("class"), F.col("class").alias("onward"))
        after = settle(
            least.join(jump, [*keys, "class"]).select(*keys, "skeleton", F.least("class", "onward").alias("class")), "spelling-classes"
        )
        changed = after.join(now.withColumnRenamed("class", "was"), [*keys, "skeleton"]).where("class <> was")
        if changed.isEmpty():
            return after
        now = after


def spelling_clusters(
    counts: DataFrame, keys: list[str], value: str = "Value", number: str = "Row_Count", min_length: int = 4, max_share: float = 0.25
) -> DataFrame:
    """Each spelling with its class, from counted distinct values per ``keys``.

    Returns keys, value, number, ``Class_Name`` (the most frequent spelling of the class; of equally
    frequent ones the first in text order), ``Class_Spellings`` and ``Class_Rows``. NULL is no
    spelling. Values without a letter or digit are a class each. Where the skeleton is shorter than
    ``min_length`` characters, only spellings of the same letters and digits are a class.
    """
    own = counts.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(number).cast("long").alias(number))
    bare = folded(F.col(value))
    # Without letters the value is its own skeleton; a mark keeps it from meeting others. Short skeletons
    # say little, so there the whole folded text stands for the spelling.
    text = skeleton(F.col(value))
    bone = F.when(bare == "", F.concat(F.lit("="), value)).when(F.length(text) < min_length, F.concat(F.lit("~"), bare)).otherwise(text)
    values = settle(own.withColumns({"folded": bare, "skeleton": bone}), "spellings")
    full = values.where(~F.col("skeleton").startswith("=") & ~F.col("skeleton").startswith("~"))
    links = near_skeletons(full, keys, min_length, max_share)
    classes = _classes(values.select(*keys, "skeleton").distinct(), links, keys)
    joined = settle(values.join(classes, [*keys, "skeleton"]), "spellings")
    named = joined.groupBy(*keys, "class").agg(
        F.min(F.struct((-F.col(number)).alias("n"), F.col(value).alias("name")))["name"].alias("Class_Name"),
        F.count("*").alias("Class_Spellings"),
        F.sum(number).cast("long").alias("Class_Rows"),
    )
    return joined.join(named, [*keys, "class"]).select(*keys, value, number, "Class_Name", "Class_Spellings", "Class_Rows")


def with_class_names(df: DataFrame, column: str, clusters: DataFrame) -> DataFrame:
    """Each value of ``column`` as the name of its class; values that no class knows stay.

    ``clusters`` holds the spellings of this column alone, as ``Value``, and should be settled.
    """
    lookup = clusters.select(F.col("Value").alias(column), F.col("Class_Name").alias("_class"))
    return attach_lookup(df, lookup, column).withColumn(column, F.coalesce("_class", column)).drop("_class")
