"""Documents that repeat themselves without a break: runs of words, found and collapsed.

A run is a stretch of words with a smallest period that no neighbouring word keeps up. Runs come from
suffix trees (``suffix_trees``) over word numbers. Trees are grown only where a run can be:
a window of ``_gram_words`` words inside a run stands there again one period away, so each run lies
within one stretch of words covered by windows that occur twice near by. This loses no run, and
most documents have no such stretch.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewmart.llm.common import ship, slices, text_bytes, words_of
from viewmart.llm.pieces import STEP
from viewmart.llm.suffix_trees import runs_of

#: Words of the stretches that share one pair of trees; a longer stretch has a pair of its own.
TREE_WORDS = 1 << 15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _gram_words(min_length: int, min_exponent: int) -> int:
    """So long that a run holds one such window and the same one period later.

    A run of period q is max(min_length, min_exponent * q) long, so without its last period it
    still has at least min_length * (min_exponent - 1) / min_exponent words.
    """
    return min(16, max(1, min_length * (min_exponent - 1) // min_exponent))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and how many words stand before each text."""
    word = ~SPACE[data]
    before = np.r_[False, word[:-1]] if len(word) else word
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = False
    after = np.r_[word[1:], False] if len(word) else word
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _bytes_of(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Marks the bytes of the words."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def number_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words, by their bytes."""
    sizes = np.r_[0, np.cumsum(ends - starts)]
    packed = data[_bytes_of(starts, ends, len(data))]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def window_keys(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ``size`` words; equal windows have equal hashes."""
    n = len(numbers) - size + 1
    part = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    part ^= part >> np.uint64(32)
    whole, width, part_width = np.zeros(n, np.uint64), 0, 1
    for bit in range(size.bit_length()):  # windows of 1, 2, 4 ... words make up one of size words
        if size >> bit & 1:
            whole = whole * STEP ** np.uint64(part_width) + part[width : width + n]
            width += part_width
        if size >> (bit + 1):
            part = part[:-part_width] * STEP ** np.uint64(part_width) + part[part_width:]
            part ^= part >> np.uint64(29)
            part_width *= 2
    return whole


def _stretches(at: np.ndarray, size: int, n: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the windows at ``at`` cover, cut where a text begins."""
    cover = np.zeros(n + 1, np.int8)
    cover[at] += 1
    cover[at + size] -= 1
    covered = np.cumsum(cover[:-1], dtype=np.int32) > 0
    starts = np.flatnonzero(covered & (first | ~np.r_[False, covered[:-1]]))
    ends = np.flatnonzero(covered & (np.r_[first[1:], True] | ~np.r_[covered[1:], False])) + 1
    return starts, ends


def repeated_stretches(numbers: np.ndarray, bounds: np.ndarray, size: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches covered by windows of ``size`` words that stand twice, near by.

    Inside a run the next or last equal window is at most a period away, and the run's stretch
    is ``min_exponent`` periods long, so windows whose nearest equal one is farther are left
    out, and so again in what then remains. Windows are compared by a hash; an accident only
    makes a stretch longer than needed.
    """
    if len(numbers) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(numbers) - size + 1
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    keys = window_keys(numbers, size)[at] ^ (text[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    order = np.argsort(keys, kind="stable")
    gap = np.where(keys[order][1:] == keys[order][:-1], np.diff(at[order]), len(numbers))
    nearest = np.empty(len(at), np.int64)
    nearest[order] = np.minimum(np.r_[gap, len(numbers)], np.r_[len(numbers), gap])
    most = np.diff(bounds)[text[at]]
    first = np.zeros(len(numbers), bool)
    first[bounds[:-1][bounds[:-1] < len(numbers)]] = True
    for _ in range(3):  # any number of rounds is right; few windows go later
        near = nearest * min_exponent <= most
        at, nearest = at[near], nearest[near]
        starts, ends = _stretches(at, size, len(numbers), first)
        most = (ends - starts)[np.searchsorted(starts, at, "right") - 1]
    return starts, ends


def runs_in(numbers: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (place of the first word among all, length, period), by place and period."""
    starts, ends = repeated_stretches(numbers, bounds, _gram_words(min_length, min_exponent), min_exponent)
    long = ends - starts >= min_length
    starts, ends = starts[long], ends[long]
    found, first = [np.zeros((0, 3), np.int64)], 0
    while first < len(starts):
        total = np.cumsum(ends[first:] - starts[first:])
        last = first + max(1, int(np.searchsorted(total, TREE_WORDS, "right")))
        rows = runs_of([numbers[a:b] for a, b in zip(starts[first:last], ends[first:last])], min_length, min_exponent)
        found.append(np.column_stack([starts[first:last][rows[:, 0]] + rows[:, 1], rows[:, 2:]]))
        first = last
    return np.concatenate(found)


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text joined by single spaces."""
    starts, ends = starts[kept], ends[kept]
    before = np.r_[0, np.cumsum(kept)][bounds]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(before))
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    sizes = ends - starts + ~last
    offsets = np.r_[0, np.cumsum(sizes)]
    out = np.full(int(offsets[-1]), 32, np.uint8)
    filled = np.ones(len(out), bool)
    filled[(offsets[1:] - 1)[~last]] = False
    out[filled] = data[_bytes_of(starts, ends, len(data))]
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets[before].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _judge(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    data, offsets = text_bytes(texts)
    starts, ends, bounds = split_words(data, offsets)
    runs = runs_in(number_words(data, starts, ends), bounds, min_length, min_exponent)
    dropped = np.zeros(len(starts) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    collapsed = _collapsed(data, starts, ends, bounds, np.cumsum(dropped[:-1]) == 0)
    # A text without words begins where the next one does, so the last text that begins there holds the run.
    owner = np.searchsorted(bounds[:-1], runs[:, 0], "right") - 1
    columns = [runs[:, 0] - bounds[owner], runs[:, 1], runs[:, 2]]
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
    per_text = np.searchsorted(owner, np.arange(len(bounds)))
    return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), rows), collapsed


def periodic_runs(
    docs: DataFrame, min_length: int = 24, min_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, runs (start, length, period; sorted by start, then period), collapsed, for every row.

    A run is at least ``min_length`` words and ``min_exponent`` (2 or more) periods long. Its words
    after the first period are dropped from ``collapsed``, in which single spaces join the others.
    NULL and empty texts, and texts of spaces only, have no runs and collapse to an empty text. Rows
    with a NULL or repeated id are judged each on its own. A text of any length is one piece of work,
    with memory of some hundred bytes a word where it repeats itself. Map-only; an empty table
    gives an empty result, and further columns are ignored.
    """
    ship(docs.sparkSession)
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                runs, collapsed = _judge(part.column("text"), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), runs, collapsed], ["doc_id", "runs", "collapsed"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(judge, f"doc_id {kind}, runs {RUNS}, collapsed string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a repeating tail in the text of one id in ten, for evaluation.

    With h the CRC-32 of the id in decimal, h divisible by 10, and g its tenth, the n words from
    number a = g % n on become the words from a on in a cycle of 1 + (n - a) / (3 + g % 8), both
    divisions rounded down; single spaces join them. Other texts, and those without an id, stay.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", crc.alias("crc"))
    # In columns of their own, or each place of a cycle would cut the text anew.
    cut = chosen.withColumn("words", F.when(F.col("crc") % 10 == 0, words_of(F.coalesce("text", F.lit("")))))
    n, seed = F.size("words").cast("long"), F.floor(F.col("crc") / 10).cast("long")
    cut = cut.withColumns({"n": n, "a": F.when(n > 0, seed % n), "seed": seed})
    cycle = F.lit(1).cast("long") + F.floor((F.col("n") - F.col("a")) / (3 + F.col("seed") % 8)).cast("long")
    cut = cut.withColumn("cycle", cycle)

    def word(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("cycle")).cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of runs and collapsed text.

    Of equal exponents the run that starts first counts, then the one of the smaller period; a
    document without runs has NULL there. Exponents are compared as exact fractions.
    """
    one = "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> " \
        "if(best is null or r.length * best.period > best.length * r.period, r, best))"
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", F.expr(one)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
