"""Removal of byte strings that an earlier document holds, with suffix arrays of shards.

Documents lie in shards, which are ranges of ids. Every window of ``length`` bytes belongs to a
context (see ``suffixes.Contexts``), and equal windows have contexts of equal seeds.

1. Each shard sends one entry of 12 bytes for each of its distinct contexts, by seed.
2. For every seed that several shards hold, they are told which contexts an earlier shard holds
   whole, and which must be compared because another context has the same seed.
3. Shards send the bytes of the latter. Suffix arrays are built over what comes together, and
   equal windows are merged across shards by binary search for the first shard that holds each.
4. Each shard builds the suffix arrays of the contexts that several of its own documents may
   share, adds what it was told, and cuts the covered bytes out of its documents.

The text is shuffled once; all steps read that one exchange.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from viewmart.llm.common import carried_names, schema_of, text_bytes, texts_of, with_own_names
from viewmart.llm.suffixes import WINDOW_BITS, Contexts, covered_windows, cut_out, hash_from

#: Text of a shard, and entries that one bucket of seeds gathers, on average.
SHARD_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
#: A seed with more contexts than this has its windows dealt out one by one, by their own hash.
HOT_CONTEXTS = 2_000

RESULT = "n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
WHOLE, COMPARE, HOT = 1, 2, 3


class Shard:
    """The documents of one shard in the order of their ids, as one run of bytes."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = text_bytes(self.table["text"].cast(pa.large_string()))
        ids = self.table["doc_id"].to_numpy()
        self.owner = np.cumsum(np.r_[0, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)

    def contexts(self, length: int) -> tuple[Contexts, np.ndarray]:
        """All contexts, and the number among the distinct documents of each one's document."""
        found = Contexts(self.data, self.offsets, length)
        return found, self.owner[np.searchsorted(self.offsets, found.start, "right") - 1]


class Entries:
    """The distinct contexts of a shard in an order that depends on its documents alone."""

    def __init__(self, contexts: Contexts, buckets: int):
        text = contexts.text_hashes()
        bucket = ((contexts.key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        key = (contexts.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((text, key, bucket))  # stable: the first of equal contexts comes first
        a, b = order[1:], order[:-1]
        new = np.r_[True, (bucket[a] != bucket[b]) | (key[a] != key[b]) | (text[a] != text[b])] if len(order) else order > 0
        self.first = order[new]
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.bucket, self.key, self.text = bucket[self.first], key[self.first], text[self.first]

    def cuts(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, low, high) of the entries of each bucket."""
        edge = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True]) if len(self.bucket) else []
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            yield int(self.bucket[low]), int(low), int(high)


def _as_bytes(columns: dict[str, list], kinds: dict) -> pa.Table:
    return pa.table({name: pa.array(values, kinds[name]) for name, values in columns.items()})


def send_entries(length: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        contexts, _ = Shard(table).contexts(length)
        entries = Entries(contexts, buckets)
        out: dict[str, list] = {"bucket": [], "shard": [], "keys": [], "texts": []}
        for bucket, low, high in entries.cuts():
            out["bucket"].append(bucket)
            out["shard"].append(key[0].as_py())
            out["keys"].append(entries.key[low:high].tobytes())
            out["texts"].append(entries.text[low:high].tobytes())
        return _as_bytes(out, {"bucket": pa.int32(), "shard": pa.int32(), "keys": pa.binary(), "texts": pa.binary()})

    return run


def answer_entries(table: pa.Table) -> pa.Table:
    """For each blob of entries, one code byte for each entry."""
    sizes = np.array([len(blob.as_py()) // 4 for blob in table["keys"]], np.int64)
    key = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32)
    text = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint64)
    shard = np.repeat(table["shard"].to_numpy().astype(np.int32), sizes)
    code = np.zeros(len(key), np.uint8)
    if len(key):
        order = np.lexsort((shard, text, key))
        k, t, s = key[order], text[order], shard[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_text = new_key | np.r_[True, t[1:] != t[:-1]]
        code[order[~new_text]] = WHOLE
        starts = np.flatnonzero(new_key)
        n_texts = np.add.reduceat(new_text.astype(np.int64), starts)
        lowest = np.minimum.reduceat(np.where(new_text, s, np.iinfo(np.int32).max), starts)
        highest = np.maximum.reduceat(np.where(new_text, s, -1), starts)
        several = (n_texts > 1) & (lowest < highest)
        kind = np.where(several, np.where(n_texts > HOT_CONTEXTS, HOT, COMPARE), 0).astype(np.uint8)
        each = np.repeat(kind, np.diff(np.r_[starts, len(k)]))
        code[order[new_text]] = each[new_text]
    ends = np.cumsum(sizes)
    codes = [code[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
    return pa.table({"shard": table["shard"], "bucket": table["bucket"], "codes": pa.array(codes, pa.binary())})


SENT = {
    "bucket": pa.int32(), "shard": pa.int32(), "keys": pa.binary(), "places": pa.binary(), "windows": pa.binary(), "seeds": pa.binary(),
    "bytes": pa.binary(), "told": pa.binary(),
}
SENT_SCHEMA = "bucket int, shard int, keys binary, places binary, windows binary, seeds binary, bytes binary, told binary"


def send_contexts(length: int, buckets: int):
    """The contexts to compare, by bucket, and the runs of windows that an earlier shard holds."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in SENT}
        if not table.num_rows or not answers.num_rows:
            return _as_bytes(out, SENT)
        shard = Shard(table)
        contexts, owner = shard.contexts(length)
        entries = Entries(contexts, buckets)
        told = dict(zip(answers["bucket"].to_pylist(), answers["codes"].to_pylist(), strict=True))
        code = np.zeros(len(entries.first), np.uint8)
        for bucket, low, high in entries.cuts():
            code[low:high] = np.frombuffer(told[bucket], np.uint8)

        def add(bucket, keys, start, windows, seeds):
            out["bucket"].append(int(bucket))
            out["shard"].append(key[0].as_py())
            out["keys"].append(keys.astype(np.uint32).tobytes())
            out["places"].append(start.astype(np.uint32).tobytes())
            out["windows"].append(windows.astype(np.uint8).tobytes())
            out["seeds"].append((seeds - start).astype(np.uint8).tobytes())
            out["bytes"].append(cut_out(shard.data, start, windows + length - 1).tobytes())
            out["told"].append(b"")

        # All places of a context in the first document that has it; step 4 finds it in later ones.
        each = code[entries.entry]
        each[owner != owner[entries.first][entries.entry]] = 0
        compare = np.flatnonzero(each == COMPARE)
        compare = compare[np.argsort(entries.entry[compare], kind="stable")]
        of = entries.bucket[entries.entry[compare]]
        for bucket in np.unique(of):
            at = compare[np.searchsorted(of, bucket) : np.searchsorted(of, bucket, "right")]
            add(bucket, entries.key[entries.entry[at]], contexts.start[at], contexts.windows[at], contexts.seed[at])
        at = np.flatnonzero(each == HOT)
        if len(at):
            n = contexts.windows[at]
            single = np.repeat(contexts.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes = hash_from(shard.data, single, length)
            bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
            for b in np.unique(bucket):
                rows = np.flatnonzero(bucket == b)
                add(b, hashes[rows] & np.uint64(0xFFFFFFFF), single[rows], np.ones(len(rows), np.int64), single[rows])
        whole = np.flatnonzero(each == WHOLE)
        if len(whole):
            start, n = contexts.start[whole], contexts.windows[whole]
            edge = np.flatnonzero(np.r_[True, start[1:] != start[:-1] + n[:-1]])
            runs = np.stack([start[edge], np.add.reduceat(n, edge)])
            out["bucket"].append(key[0].as_py() % buckets)
            out["shard"].append(key[0].as_py())
            for name in ("keys", "places", "windows", "seeds", "bytes"):
                out[name].append(b"")
            out["told"].append(runs.astype(np.uint32).tobytes())
        return _as_bytes(out, SENT)

    return run


def merge_contexts(length: int):
    """Single windows that an earlier shard holds, as (start, number) runs for each shard."""

    def run(table: pa.Table) -> pa.Table:
        shards, runs = [], []
        for shard, told in zip(table["shard"].to_pylist(), table["told"].to_pylist(), strict=True):
            if told:
                shards.append(shard)
                runs.append(told)
        key = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32)
        place = np.frombuffer(b"".join(table["places"].to_pylist()), np.uint32).astype(np.int64)
        windows = np.frombuffer(b"".join(table["windows"].to_pylist()), np.uint8).astype(np.int64)
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        sizes = np.array([len(x) // 4 for x in table["keys"].to_pylist()], np.int64)
        owner = np.repeat(table["shard"].to_numpy().astype(np.int64), sizes)
        span = windows + length - 1
        start = np.cumsum(span) - span
        seed = start + np.frombuffer(b"".join(table["seeds"].to_pylist()), np.uint8)
        context, window = covered_windows(data, start, windows, key, owner, length, seed)
        at, of = place[context] + window, owner[context]
        order = np.lexsort((at, of))
        at, of = at[order], of[order]
        for shard in np.unique(of):
            mine = at[np.searchsorted(of, shard) : np.searchsorted(of, shard, "right")]
            edge = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1] + 1])
            shards.append(int(shard))
            runs.append(np.stack([mine[edge], np.diff(np.r_[edge, len(mine)])]).astype(np.uint32).tobytes())
        return pa.table({"shard": pa.array(shards, pa.int32()), "told": pa.array(runs, pa.binary())})

    return run


def cut_documents(length: int, passed: list[str]):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(table)
        data, offsets = shard.data, shard.offsets
        depth = np.zeros(len(data) + 1, np.int32)
        for told in answers["told"].to_pylist() if answers.num_rows else []:
            start, n = np.frombuffer(told, np.uint32).astype(np.int64).reshape(2, -1)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + n + length - 1, -1)
        contexts, owner = shard.contexts(length)
        order = np.lexsort((owner, contexts.key))
        k, o = contexts.key[order], owner[order]
        if len(k):
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            several = np.repeat(o[starts] != o[np.r_[starts[1:], len(k)] - 1], np.diff(np.r_[starts, len(k)]))
            own = np.sort(order[several])
            context, window = covered_windows(
                data, contexts.start[own], contexts.windows[own], contexts.key[own], owner[own], length, contexts.seed[own]
            )
            at = contexts.start[own][context] + window
            np.add.at(depth, at, 1)
            np.add.at(depth, at + length, -1)
        np.cumsum(depth, dtype=np.int32, out=depth)
        removed = depth[:-1] > 0
        del depth
        # Runs never cross documents, as windows do not; adjoining runs of two documents are parted.
        text_start = np.zeros(len(data) + 1, bool)
        text_start[offsets] = True
        begin = np.flatnonzero(removed & (np.r_[True, ~removed[:-1]] | text_start[:-1]))
        end = np.flatnonzero(removed & (np.r_[~removed[1:], True] | text_start[1:])) + 1
        document = np.searchsorted(offsets, begin, "right") - 1
        per_document = np.searchsorted(begin, offsets)
        # Of documents that start at one place, all but the last are empty and have no runs.
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - offsets[document], pa.int64()), pa.array(end - offsets[document], pa.int64())], ["start", "stop"]
        )
        rest = data[~removed]
        # Of each document the bytes before it, without those of the runs before it.
        cut = np.r_[0, np.cumsum(end - begin)]
        kept = offsets - cut[per_document]
        return pa.table({name: shard.table[name] for name in passed} | {
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(per_document, pa.int32()), spans),
            "kept": pa.array([rest[a:b].tobytes() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
        })

    return run


def shard_bounds(texts: DataFrame, shard_bytes: int) -> tuple[np.ndarray, int]:
    """The largest ids of all shards but the last, and the bytes of all texts.

    The bounds are eight bytes for each ``shard_bytes`` of text, and are sent to every task.
    """
    total, rows = texts.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    total = total or 0
    shards = int(min(max(1, -(-total // shard_bytes)), max(rows, 1)))
    if shards == 1:
        return np.zeros(0, np.int64), total
    shares = [i / shards for i in range(1, shards)]
    cut = texts.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * shards))).first()[0]
    return np.unique(np.array(cut, np.int64)), total


def suffix_dedup(
    docs: DataFrame,
    length: int = 50,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges from start to before stop), kept (the other bytes).

    The columns of ``docs`` that ``carry`` names follow.

    A byte is removed if a string of ``length`` bytes (16 or more) that covers it also starts in
    a document with a smaller id. Strings are those of the UTF-8 input. Ids are integers; rows
    that repeat an id do not remove each other's bytes. NULL text is empty; texts shorter than
    ``length`` are kept whole. A row with a NULL id is kept whole and removes nothing. An empty
    table gives an empty result. Whole texts of any length are searched.
    """
    if length < 16 or length - (length - WINDOW_BITS + 1 if length >= 40 else (length + 1) // 2) + 1 > WINDOW_BITS:
        raise ValueError("length is 16 or more")
    texts, passed = texts_of(docs, id_col, text_col, carry), ["doc_id", *carried_names(carry)]
    known = texts.where("doc_id is not null")
    bounds, total = shard_bounds(known, shard_bytes)
    shards = len(bounds) + 1
    buckets = max(1, -(-total // (BUCKET_BYTES * 5 // 4)))

    @pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy()).astype(np.int32))

    dealt = known.select(shard_of("doc_id").alias("shard"), "*").repartition(shards, "shard")
    by_shard = dealt.groupBy("shard")
    entries = by_shard.applyInArrow(send_entries(length, buckets), "bucket int, shard int, keys binary, texts binary")
    answers = entries.groupBy("bucket").applyInArrow(answer_entries, "shard int, bucket int, codes binary")
    sent = by_shard.cogroup(answers.groupBy("shard")).applyInArrow(send_contexts(length, buckets), SENT_SCHEMA)
    merged = sent.groupBy("bucket").applyInArrow(merge_contexts(length), "shard int, told binary")
    result = by_shard.cogroup(merged.groupBy("shard")).applyInArrow(cut_documents(length, passed), f"{schema_of(texts, passed)}, {RESULT}")
    nameless = texts.where("doc_id is null").select(
        *passed,
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return with_own_names(result.unionByName(nameless), carry)


def suffix_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
