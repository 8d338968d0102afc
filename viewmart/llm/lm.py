"""Language-model scoring with a probabilistic suffix tree over words.

Every word is a symbol, and each text ends with an end symbol, which also stands before its first word. A
context is a run of up to ``depth`` symbols. Those that occur ``support`` times or more in training are
tested, and kept if their next-symbol distribution diverges from that of the context without its
first symbol. A kept context smooths its counts towards its longest kept proper suffix, the root being
the unigram base. Each symbol is scored in the longest kept context that ends before it.

The model is a set of rows that Spark shuffles, so it grows with the corpus; no part of it comes to the
driver or goes to every task. Texts are dealt to shards. A shard sends its distinct events (a
context and the symbol after it) with their counts to buckets and gets their totals over the corpus
back, so no token is shuffled on its own and a frequent event is one entry a shard. The total of
an event is the number of times that its symbols occur as the next longer context.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from viewmart.llm.common import text_bytes, texts_of
from viewmart.llm.pieces import hash_runs

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The end symbol's hash.
END = np.uint64(0x9E3779B97F4A7C15)
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Kinds of messages: totals of words and of pairs, sums for the test of contexts of one word; longer contexts
#: go by their length.
WORDS, PAIRS, SINGLE = 0, 1, -1


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each starts in them, and the text of each word."""
    data, offsets = text_bytes(texts)
    space = SPACE[data]
    inside = ~space
    start, end = inside.copy(), inside.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = inside[first]
    end[first[1:] - 1] = inside[first[1:] - 1]
    at = np.flatnonzero(start)
    sizes = np.flatnonzero(end) + 1 - at
    return LOWER[data[inside]], np.cumsum(sizes) - sizes, np.searchsorted(offsets, at, "right") - 1


def mixed(value: np.ndarray) -> np.ndarray:
    """The numbers with their bits stirred."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def followed(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more symbol."""
    return mixed(context * np.uint64(0xD6E8FEB86659FD93) + symbol)


def _deflated(blob: bytes) -> bytes:
    return np.int64(len(blob)).tobytes() + pa.compress(blob, codec="zstd", asbytes=True)


def _inflated(blob: bytes) -> bytes:
    length = int(np.frombuffer(blob, np.int64, 1)[0])
    return pa.decompress(blob[8:], length, codec="zstd", asbytes=True) if length else b""


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return _deflated(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def full(blob: bytes, kind: type) -> np.ndarray:
    """The numbers of a squeezed blob."""
    planes = np.frombuffer(_inflated(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rising(values: np.ndarray) -> bytes:
    """Numbers that ascend, as squeezed steps."""
    return squeezed(np.diff(values, prepend=values.dtype.type(0)))


def risen(blob: bytes, kind: type) -> np.ndarray:
    return np.cumsum(full(blob, kind), dtype=kind)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the numbers of its hashes, which ascend, so that their steps squeeze well."""
    order = np.argsort(hashes)  # they are distinct
    bucket = bucket_of(hashes[order], buckets)
    back = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    order, ordered = order[back], bucket[back]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if len(ordered) else np.zeros(0, np.int64)
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(ordered[low]), order[low:high]


def deflate_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each text squeezed by itself, for the shuffle."""
    for batch in batches:
        place = batch.schema.get_field_index("text")
        texts = pa.array([_deflated(blob) for blob in batch.column(place).cast(pa.binary()).to_pylist()], pa.binary())
        yield batch.set_column(place, "text", texts)


@dataclass
class Level:
    """Distinct events of contexts of one length in a shard, in the order of their contexts."""

    at: np.ndarray  # the event of each place, -1 for none
    hashes: np.ndarray
    context: np.ndarray  # an event of the level above: the same symbols but the last
    symbol: np.ndarray
    parent: np.ndarray  # an event of the level above: the same symbols but the first
    own: np.ndarray  # times in the shard's training texts
    total: np.ndarray | None = None  # times in all training texts
    number: np.ndarray | None = None  # of a word, and of a pair within its bucket, the same in all shards


class Shard:
    """The events of a shard's texts; the same texts in any order give the same events in the same order."""

    def __init__(self, table: pa.Table):
        n = table.num_rows
        data, starts, text = words_of(pa.array([_inflated(blob) for blob in table["text"].to_pylist()], pa.large_binary()))
        hashes, inverse = np.unique(hash_runs(data, starts), return_inverse=True)
        sizes = np.bincount(text, minlength=n) + 2
        self.text = np.repeat(np.arange(n), sizes)
        first = np.cumsum(sizes) - sizes
        self.flat = np.full(len(self.text), len(hashes), np.int64)
        self.flat[np.arange(len(text)) + 2 * text + 1] = inverse
        self.inner = np.ones(len(self.flat), bool)
        self.inner[first] = False
        self.learned = table["learn"].to_numpy(zero_copy_only=False)[self.text] & self.inner
        words, none = np.r_[hashes, END], np.zeros(len(hashes) + 1, np.int64)
        own = np.bincount(self.flat, self.learned, len(words)).astype(np.int64)
        self.levels = [Level(self.flat, words, none, np.arange(len(words)), none, own)]

    def deepen(self, support: int = 0) -> Level:
        """One more symbol before each place, where these symbols occur ``support`` times in training."""
        before, width = self.levels[-1], len(self.levels[0].hashes)
        context = np.r_[-1, before.at[:-1]]
        place = np.flatnonzero(self.inner & (context >= 0))
        if support:
            place = place[before.total[context[place]] >= support]
        pairs, back = np.unique(context[place] * width + self.flat[place], return_inverse=True)
        at = np.full(len(self.flat), -1, np.int64)
        at[place] = back
        above, symbol = pairs // width, pairs % width
        own = np.bincount(back, self.learned[place], len(pairs)).astype(np.int64)
        hashes = followed(before.hashes[above], self.levels[0].hashes[symbol])
        parent = np.zeros(len(pairs), np.int64)
        parent[back] = before.at[place]
        self.levels.append(Level(at, hashes, above, symbol, parent, own))
        return self.levels[-1]

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The deepest level's contexts, its events that are asked for, and the first and the number of each context's.

        An event that its parent never saw cannot have been seen, and is not asked for.
        """
        above, level = self.levels[-2:]
        wanted = above.total[level.parent] > 0
        contexts, own = np.unique(level.context, return_inverse=True)
        sizes = np.bincount(own, wanted, len(contexts)).astype(np.int64)
        return contexts, np.flatnonzero(wanted), np.c_[np.cumsum(sizes) - sizes, sizes]


def _ranges(parts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each (first, size)."""
    sizes = parts[:, 1]
    return np.repeat(parts[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


MESSAGE = "bucket int, shard int, kind int, keys binary, sizes binary, nexts binary, counts binary, parents binary, wholes binary"
ANSWER = "shard int, kind int, bucket int, counts binary, types binary, numbers binary"
#: Lower bits left out of a pair's hash within its bucket, and of that of a context of three words or more.
PAIR_CUT, CONTEXT_CUT = np.uint64(20), np.uint64(16)


def _rows(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table({name: pa.array([row.get(name) for row in rows], kinds[kind]) for name, kind in fields})


def send_counts(buckets: int):
    """Distinct words and pairs of a shard, with their counts in its training texts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, number = Shard(table), key[0].as_py()
        shard.deepen()
        rows = []
        for kind, level in enumerate(shard.levels):
            for bucket, own in by_bucket(level.hashes, buckets):
                keys = level.hashes[own] if kind == WORDS else level.hashes[own] >> PAIR_CUT
                rows.append({"bucket": bucket, "shard": number, "kind": kind, "keys": rising(keys), "counts": squeezed(level.own[own])})
        return _rows(MESSAGE, rows)

    return run


def _joined(rows: list[dict], name: str, kind: type, read=full) -> np.ndarray:
    return np.concatenate([read(row[name], kind) for row in rows] or [np.zeros(0, kind)])


def _of_kind(table: pa.Table, *kinds: int) -> list[dict]:
    return table.filter(pa.compute.is_in(table["kind"], pa.array(kinds, pa.int32()))).to_pylist()


def _totals(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key of all messages, and the sum of each number."""
    _, number = np.unique(_joined(rows, "keys", np.uint64, risen), return_inverse=True)
    return number, np.bincount(number, _joined(rows, "counts", np.int64)).astype(np.int64)


def _dealt(rows: list[dict], name: str, kind: type) -> Iterator[slice]:
    """Where each message's numbers lie among those of all."""
    low = 0
    for row in rows:
        high = low + int(np.frombuffer(row[name], np.int64, 1)[0]) // np.dtype(kind).itemsize
        yield slice(low, high)
        low = high


def answer_counts(support: int):
    """The totals of all keys, to each shard that sent them, with the numbers they go by from then on.

    Words are numbered from the most frequent on, so that most numbers are small; of pairs only those that
    are tested as contexts, in the order of their keys.
    """

    def run(table: pa.Table) -> pa.Table:
        result = []
        for kind in (WORDS, PAIRS):
            rows = _of_kind(table, kind)
            number, total = _totals(rows)
            named = total >= (0 if kind == WORDS else support)
            names = np.cumsum(named) - 1
            if kind == WORDS:
                names[np.argsort(-total, kind="stable")] = np.arange(len(total))
            for row, own in zip(rows, _dealt(rows, "counts", np.int64), strict=True):
                mine = number[own]
                given = names[mine[named[mine]]]
                result.append({
                    "shard": row["shard"], "kind": kind, "bucket": row["bucket"], "counts": squeezed(total[mine]),
                    "numbers": squeezed(given) if kind == WORDS else rising(given),
                })
        return _rows(ANSWER, result)

    return run


def count_words(table: pa.Table) -> pa.Table:
    """Distinct words of a bucket that training has, and their tokens; ends count as a word."""
    _, total = _totals(_of_kind(table, WORDS))
    return pa.table({"types": pa.array([int((total > 0).sum())]), "tokens": pa.array([int(total.sum())])})


class Told:
    """What buckets answered to one shard."""

    def __init__(self, answers: pa.Table):
        rows = answers.to_pylist()
        self.blobs = {(row["kind"], row["bucket"]): (row["counts"], row["types"], row["numbers"]) for row in rows}
        self.types, self.tokens = (rows[0]["n_types"], rows[0]["n_tokens"]) if rows else (0, 0)

    def fill(self, shard: Shard, level: int, support: int, buckets: int) -> None:
        """Totals and numbers of words, and of pairs; a pair below ``support`` has no number."""
        here = shard.levels[level]
        here.total, here.number = np.zeros(len(here.hashes), np.int64), np.full(len(here.hashes), -1)
        for bucket, own in by_bucket(here.hashes, buckets):
            counts, _, numbers = self.blobs[level, bucket]
            here.total[own] = full(counts, np.int64)
            if level == WORDS:
                here.number[own] = full(numbers, np.int64) * buckets + bucket
            else:
                here.number[own[here.total[own] >= support]] = risen(numbers, np.int64)

    def deepen(self, shard: Shard, length: int, support: int, buckets: int) -> np.ndarray:
        """A longer level with its totals; the number of next symbols of each of its contexts, 0 for one not kept."""
        above, here = shard.levels[-1], shard.deepen(support)
        here.total = np.zeros(len(here.hashes), np.int64)
        types = np.zeros(len(above.hashes), np.int64)
        contexts, asked, parts = shard.groups()
        for bucket, own in by_bucket(above.hashes[contexts], buckets):
            counts, kept, _ = self.blobs[length, bucket]
            here.total[asked[_ranges(parts[own])]] = full(counts, np.int64)
            types[contexts[own]] = full(kept, np.int64)
        return types

    def single(self, shard: Shard, support: int, buckets: int) -> np.ndarray:
        """The number of next symbols of each word as a context, 0 for one not kept."""
        words = shard.levels[0]
        types, asked = np.zeros(len(words.hashes), np.int64), np.flatnonzero(words.total >= support)
        for bucket, own in by_bucket(words.hashes[asked], buckets):
            types[asked[own]] = full(self.blobs[SINGLE, bucket][1], np.int64)
        return types


def told_shard(table: pa.Table, answers: pa.Table, length: int, support: int, buckets: int) -> tuple[Shard, Told, list]:
    """A shard with totals of contexts below ``length``, and the next symbols of those of two symbols on."""
    shard, told = Shard(table), Told(answers)
    told.fill(shard, WORDS, support, buckets)
    shard.deepen()
    told.fill(shard, PAIRS, support, buckets)
    return shard, told, [told.deepen(shard, k, support, buckets) for k in range(2, length)]


def _log(values: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(values, 1))


def send_level(length: int, support: int, buckets: int):
    """Events of contexts of ``length`` symbols with their parents' log shares, grouped by context.

    The first time, with each word's part in the test of contexts of one word: a training place adds the
    log ratio of the pair's share to the symbol's, and its part of a distinct next symbol.
    """

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(MESSAGE, [])
        number, rows = key[0].as_py(), []
        shard, told, _ = told_shard(table, answers, length, support, buckets)
        if length == 2:
            words, pairs = shard.levels[:2]
            seen = np.flatnonzero(pairs.own)
            own, total, context = pairs.own[seen], pairs.total[seen], pairs.context[seen]
            ratio = _log(total) - _log(words.total[context]) - _log(words.total[pairs.symbol[seen]]) + np.log(max(told.tokens, 1))
            gain = np.bincount(context, own * ratio, len(words.hashes)).astype(np.float32)
            types = np.bincount(context, own / np.maximum(total, 1), len(words.hashes)).astype(np.float32)
            asked = np.flatnonzero(words.total >= support)
            for bucket, own in by_bucket(words.hashes[asked], buckets):
                own = asked[own]
                rows.append({
                    "bucket": bucket, "shard": number, "kind": SINGLE, "keys": squeezed(words.hashes[own]),
                    "counts": squeezed(types[own]), "parents": squeezed(gain[own]),
                })
        above, here = shard.levels[-1], shard.deepen(support)
        contexts, asked, parts = shard.groups()
        names = above.number if length == 2 else (above.hashes >> CONTEXT_CUT).astype(np.int64)
        for bucket, own in by_bucket(above.hashes[contexts], buckets):
            events, chosen = asked[_ranges(parts[own])], contexts[own]
            rows.append({
                "bucket": bucket, "shard": number, "kind": length, "keys": rising(names[chosen]),
                "sizes": squeezed(parts[own, 1]), "nexts": squeezed(shard.levels[0].number[here.symbol[events]]),
                "counts": squeezed(here.own[events]), "parents": squeezed(above.total[here.parent[events]]),
                "wholes": squeezed(shard.levels[-3].total[above.parent[chosen]]),
            })
        return _rows(MESSAGE, rows)

    return run


def _examples(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and the number of each place's value."""
    distinct, number = np.unique(values, return_inverse=True)
    place = np.zeros(len(distinct), np.int64)
    place[number] = np.arange(len(values))
    return place, number


def answer_level(table: pa.Table) -> pa.Table:
    """Totals of events and, of contexts that diverge from their parents, the number of next symbols.

    A context is kept if its log-likelihood gain over its parent's distribution exceeds that number.
    """
    result = []
    table = table.sort_by("shard")  # sums of fractions in one order
    rows = _of_kind(table, SINGLE)
    _, number = np.unique(_joined(rows, "keys", np.uint64), return_inverse=True)
    types, gain = (np.bincount(number, _joined(rows, name, np.float32)) for name in ("counts", "parents"))
    kept = np.where(gain > types, np.rint(types), 0).astype(np.int64)
    for row, own in zip(rows, _dealt(rows, "keys", np.uint64), strict=True):
        result.append({"shard": row["shard"], "kind": SINGLE, "bucket": row["bucket"], "types": squeezed(kept[number[own]])})
    rows = table.filter(pa.compute.greater(table["kind"], PAIRS)).to_pylist()
    keys, sizes = _joined(rows, "keys", np.int64, risen), _joined(rows, "sizes", np.int64)
    example, context = _examples(keys)
    nexts = _joined(rows, "nexts", np.int64)
    event = np.repeat(context, sizes) * (nexts.max(initial=0) + 1) + nexts
    first, number = _examples(event)
    total = np.bincount(number, _joined(rows, "counts", np.int64)).astype(np.int64)
    own = np.repeat(context, sizes)[first]
    whole = np.bincount(own, total, len(example))
    share = _log(_joined(rows, "parents", np.int64)[first]) - _log(_joined(rows, "wholes", np.int64)[example])[own]
    gain = np.bincount(own, total * (_log(total) - _log(whole)[own] - share), len(example))
    types = np.bincount(own, total > 0, len(example))
    kept = np.where(gain > types, types, 0).astype(np.int64)
    places = zip(rows, _dealt(rows, "counts", np.int64), _dealt(rows, "keys", np.int64), strict=True)
    for row, events, contexts in places:
        answer = {"counts": squeezed(total[number[events]]), "types": squeezed(kept[context[contexts]])}
        result.append({"shard": row["shard"], "kind": row["kind"], "bucket": row["bucket"]} | answer)
    return _rows(ANSWER, result)


def probabilities(shard: Shard, types: list[np.ndarray], root: np.ndarray) -> np.ndarray:
    """The probability of each place's symbol in the longest kept context before it; 1 at a text's start.

    ``types[k - 1]`` has the next symbols of contexts of length k, 0 for one not kept. A kept context with n
    occurrences and t next symbols gives its parent's distribution the weight t / (n + t).
    """
    result, below = root[shard.flat], root
    for above, level, own in zip(shard.levels, shard.levels[1:], types, strict=False):
        weight = own[level.context]
        smoothed = (level.total + weight * below[level.parent]) / np.maximum(above.total[level.context] + weight, 1)
        below = np.where(weight > 0, smoothed, below[level.parent])
        hit = level.at >= 0
        result[hit] = below[level.at[hit]]
    return np.where(shard.inner, result, 1.0)


def score_shard(depth: int, support: int, buckets: int):
    """Per document: tokens, known ones, the unigram base and the tree's log10 probability."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        n = table.num_rows
        names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not n:
            empty = [table["doc_id"], table["learn"], *[pa.array([], pa.int64())] * 3, *[pa.array([], pa.float64())] * 2]
            return pa.table(dict(zip(names, empty, strict=True)))
        shard, told, longer = told_shard(table, answers, depth + 1, support, buckets)
        types = [told.single(shard, support, buckets), *longer] if depth > 1 else []
        total = shard.levels[0].total
        root = (total + 0.5) / (told.tokens + 0.5 * (told.types + 1))
        base = np.where(shard.inner, np.log10(root)[shard.flat], 0.0)
        tree = np.log10(probabilities(shard, types, root))
        tokens, known = (np.bincount(shard.text, values, n) for values in (shard.inner, shard.inner & (total[shard.flat] > 0)))
        columns = [
            table["doc_id"], table["learn"], pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)),
            pa.array(np.full(n, told.tokens, np.int64)), pa.array(np.bincount(shard.text, base, n)), pa.array(np.bincount(shard.text, tree, n)),
        ]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def lm_scores(
    docs: DataFrame, learn_from: Column, depth: int = 2, support: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``learn_from`` is a condition on ``doc_id``; rows that meet it train both models. Words are
    runs of bytes between spaces and tabs to carriage returns, A-Z in lower case; each text has
    one end token after them. ``base_score`` is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))). ``score`` is log10 of the tree's probability of the
    text; like the base, it has one outcome for all unseen words. ``support`` is the number of
    occurrences from which a context is tested, whatever the corpus; ``depth`` (2 or more) is the longest
    context and costs a further pass over the texts for each symbol beyond two.

    Words go by a hash of 64 bits and pairs by 44 bits within their bucket, whose size does not grow; then
    both go by numbers that the buckets give them. Contexts of three words and more go by 48 bits.
    NULL and empty texts are a single end token. A row with a NULL id is scored and teaches
    nothing; repeated ids keep their rows. Without training rows the tree is uniform and N = 0.
    Whole texts of any length are scored; an empty table gives an empty result.
    """
    if depth < 2:
        raise ValueError("depth is 2 or more")
    texts = texts_of(docs, id_col, text_col).withColumn("learn", F.coalesce(learn_from, F.lit(False)))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = int(size // SHARD_BYTES + 1), int(size // BUCKET_BYTES + 1)
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    kind = texts.schema["doc_id"].dataType.simpleString()
    dealt = texts.select(shard.alias("shard"), "doc_id", "learn", "text")
    dealt = dealt.mapInArrow(deflate_texts, f"shard int, doc_id {kind}, learn boolean, text binary").repartition(shards, "shard")
    by_shard = dealt.groupBy("shard")

    sent = by_shard.applyInArrow(send_counts(buckets), MESSAGE).groupBy("bucket")
    words = sent.applyInArrow(count_words, "types long, tokens long")
    words = words.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("n_types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
    answers = sent.applyInArrow(answer_counts(support), ANSWER).repartition(shards, "shard")

    def told(rows: DataFrame):
        return by_shard.cogroup(rows.crossJoin(F.broadcast(words)).groupBy("shard"))  # one row beside each

    for length in range(2, depth + 1):
        sent = told(answers).applyInArrow(send_level(length, support, buckets), MESSAGE)
        # A union of tables that are dealt out alike is so too: the answers so far are not sent anew.
        answers = answers.union(sent.groupBy("bucket").applyInArrow(answer_level, ANSWER).repartition(shards, "shard"))
    schema = f"doc_id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told(answers).applyInArrow(score_shard(depth, support, buckets), schema)
