"""SimHash near-duplicates, joined with the pigeonring filter.

A fingerprint is cut into ``max_bits + 1`` segments on a ring. If two fingerprints differ in at
most ``max_bits`` bits, some segment starts a chain of segments whose cumulative differences
stay within proportional budgets: none in the first, at most one bit in the first two, and so on
round the ring. A fingerprint is therefore filed under each pair of adjoining segments, and
under that pair with one set bit of the second segment cleared. Only fingerprints filed together
are compared: first the longer chains, then all bits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from viewmart.llm.common import settle, slices, text_bytes, texts_of
from viewmart.llm.components import components

LANES = np.uint64(0x0101010101010101)


def fingerprint_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per run of hashes: a bit is set if it is in over half of the run.

    Bit counts are kept in the eight bytes of a word, so a run is summed in parts of 255.
    """
    result = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return result
    parts = -(-sizes[full] // 255)
    first = np.r_[0, np.cumsum(sizes[full])[:-1]]
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + 255 * nth
    run = np.cumsum(parts) - parts
    half = sizes[full].astype(np.uint32)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.uint32), run, axis=0)
        bits = (2 * counts > half[:, None]).astype(np.uint8)
        result[full] |= bits.view(np.uint64).ravel() << np.uint64(k)
    return result


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of lower-case words, joined by spaces; of all words if there are fewer."""
    tokens = text.lower().split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    runs = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return [digest(run, 42) for run in runs]


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) for every row; NULL text and text without words have fingerprint 0."""
    texts = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                whole, ends = data.tobytes(), offsets.tolist()
                hashes = [shingle_hashes(whole[a:b], shingle_words) for a, b in zip(ends, ends[1:], strict=False)]
                sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
                flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(sizes.sum()))
                bits = fingerprint_bits(flat, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits)], ["doc_id", "fingerprint"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fingerprint long")


class Ring:
    """Segment borders, chain masks and keys for one number of bits."""

    def __init__(self, max_bits: int):
        if not 1 <= max_bits <= 7:
            raise ValueError("max_bits is from 1 to 7")
        self.max_bits, self.segments = max_bits, max_bits + 1
        borders = [64 * i // self.segments for i in range(self.segments + 1)]
        self.low = borders[:-1]
        self.width = [b - a for a, b in zip(borders, borders[1:], strict=False)]
        masks = [((1 << w) - 1) << low for low, w in zip(self.low, self.width, strict=True)]
        # chain[l][i]: the bits of the l + 1 segments from the i-th on; budget[l]: what may differ there
        self.chain = [
            np.array([sum(masks[(i + k) % self.segments] for k in range(length)) for i in range(self.segments)], np.uint64)
            for length in range(1, self.segments + 1)
        ]
        self.budget = [length * max_bits // self.segments for length in range(1, self.segments + 1)]

    def keys(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, key, home) of each filing: the pair of segments itself, then with one set bit cleared."""
        every = np.arange(len(prints))
        for i in range(self.segments):
            j = (i + 1) % self.segments
            a = (prints >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)
            b = (prints >> np.uint64(self.low[j])) & np.uint64((1 << self.width[j]) - 1)
            key = np.uint64(i << 60) | (a << np.uint64(32)) | b
            yield every, key, True
            for bit in range(self.width[j]):
                rows = np.flatnonzero(b & np.uint64(1 << bit))
                yield rows, key[rows] ^ np.uint64(1 << bit), False

    def linked(self, key: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether differences ``x`` of pairs filed under ``key`` pass every chain and the full check."""
        start = (key >> np.uint64(60)).astype(np.int64)
        alive = np.arange(len(x))
        for masks, budget in zip(self.chain, self.budget, strict=True):
            alive = alive[np.bitwise_count(x[alive] & masks[start[alive]]) <= budget]
        result = np.zeros(len(x), bool)
        result[alive] = True
        return result


def roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots above ``at``, whose paths are shortened."""
    found = parent[at]
    while True:
        above = parent[found]
        if (above == found).all():
            parent[at] = found
            return found
        found = above


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]."""
    while len(a):
        x, y = roots(parent, a), roots(parent, b)
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def _link_runs(ring: Ring, key: np.ndarray, prints: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For rows sorted by key: the row that stands for each row's linked set.

    Row i is compared with row i + 1, i + 2 ... while the key is the same, all rows at once.
    Memory is a few arrays of the rows' length; links are united as they are found.
    """
    n = len(key)
    parent = np.arange(n)
    last = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    end = np.repeat(last, np.diff(np.r_[-1, last]))
    alive, step = np.arange(n), 1
    while len(alive := alive[end[alive] >= alive + step]):
        a, b = alive, alive + step
        useful = home[a] | home[b]
        a, b = a[useful], b[useful]
        near = ring.linked(key[a], prints[a] ^ prints[b])
        unite(parent, a[near], b[near])
        step += 1
    return roots(parent, np.arange(n))


def near_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) ids that connect all rows of (doc_id, fingerprint) within ``max_bits`` bits.

    Fingerprints must be distinct. The links found in a task span its linked sets, rather than
    being all pairs, so a group of n near copies gives n - 1 links there.
    """
    ring = Ring(max_bits)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, key, home in ring.keys(own):
                if len(rows):
                    cut = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(rows), home)), cut.column("fingerprint"), cut.column("doc_id")],
                        ["key", "home", "fingerprint", "doc_id"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            key = table["key"].to_numpy().view(np.uint64)
            own = _link_runs(ring, key, table["fingerprint"].to_numpy().view(np.uint64), table["home"].to_numpy())
            rows = np.flatnonzero(own != np.arange(len(own)))
            ids = table["doc_id"].combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), ids.take(pa.array(own[rows]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            table = pa.Table.from_batches([batch])
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if cut:
                yield links(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            held.append(table.slice(cut))
        if held:
            yield links(pa.concat_tables(held))

    kind = prints.schema["doc_id"].dataType.simpleString()
    filed = prints.select("doc_id", "fingerprint").mapInArrow(file, f"key long, home boolean, fingerprint long, doc_id {kind}")
    dealt = filed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def simhash_dedup(
    docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept (doc_id = component_id) for every row.

    Rows link when their fingerprints differ in ``max_bits`` bits (1 to 7) or fewer;
    ``component_id`` is the smallest id that links reach. NULL and word-free texts have
    fingerprint 0 and link like others. A row with a NULL id has a fingerprint but neither
    component nor links, and is not kept. Rows that repeat an id are each linked by their own
    text. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    holders = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"), "holders")
    grouped = components(near_links(holders, max_bits))
    classes = (
        holders.join(grouped, holders["doc_id"] == grouped["node"], "left")
        .select("fingerprint", F.coalesce("component", "doc_id").alias("component_id"))
    )
    joined = prints.join(classes, "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
