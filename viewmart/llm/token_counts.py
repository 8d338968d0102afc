"""Token counts through a cache keyed by digests of the content and of the tokenizer file.

1. A digest stands for each text. One row per distinct digest is looked up in the cache.
2. Only digests that the cache lacks are encoded, each once: its smallest document id fetches the
   text, so the text of known documents is never shuffled and a hot text never meets in one task.
3. New counts are appended to the cache, and every document is joined with the cache.
"""

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewmart.llm.common import new_folder, single_threaded_tokenizers, slices, text_bytes, texts_of
from viewmart.llm.pieces import PieceMemo, split_pieces, sum_by_text

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Distinct pieces whose counts a worker remembers; it starts anew beyond that.
MEMO_PIECES = 400_000


class TokenCounter:
    """Counts tokens as the library does, with pieces between spaces counted once.

    A byte-level pre-tokenizer never joins text across a space that stands between two other
    characters, so such pieces may be counted apart. Other kinds of tokenizer get whole texts.
    """

    def __init__(self, path: str):
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.model, self.by_piece = sentencepiece.SentencePieceProcessor(model_file=path), False
            return
        single_threaded_tokenizers()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        before, added = described.get("pre_tokenizer") or {}, described.get("added_tokens", [])
        self.by_piece = (
            described.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not any(" " in t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        )
        self._forget()
        self.memo = PieceMemo(self._learn, self._forget, MEMO_PIECES)

    def clear(self) -> None:
        if self.by_piece:
            self.memo.clear()

    def _forget(self) -> None:
        self.n_tokens = np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        self.n_tokens = np.r_[self.n_tokens, self._lengths([piece.decode() for piece in pieces])]

    def _lengths(self, texts: list[str]) -> list[int]:
        if self.sentencepiece:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        return [len(done.ids) for done in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not self.by_piece:
            return np.array(self._lengths(texts.to_pylist()), np.int64)
        data, offsets = text_bytes(texts)
        starts = split_pieces(data, offsets)
        numbers = self.memo(data, starts)
        return sum_by_text(self.n_tokens[numbers], starts, offsets)


@lru_cache(maxsize=4)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Of the content as the tokenizers here see it: NULL is empty, and nothing else is normalised."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def encode_misses(misses: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                n = counter.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])
        counter.clear()

    return misses.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, digest, n_bytes, n_tokens.

    ``tokenizer_path`` must name the same file on the driver and on the executors.
    ``cache_path`` is a Parquet folder on shared storage that later calls may use again; without
    one, a new folder below ``spark.checkpoint.dir`` is used. It is read and appended to.

    NULL text counts as empty and has 0 tokens. A NULL or repeated id keeps all its rows. Texts
    of any length are encoded whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_folder(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    keyed = texts_of(docs, id_col, text_col).withColumn("digest", content_digest(F.col("text")))

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("holder")).join(cache, "digest", "left_anti")
    held = keyed.alias("k").join(
        wanted.alias("w"), F.col("k.doc_id").eqNullSafe(F.col("w.holder")) & (F.col("k.digest") == F.col("w.digest"))
    )
    new = encode_misses(held.select("k.digest", "k.text"), tokenizer_path).dropDuplicates(["digest"])
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    counts = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
