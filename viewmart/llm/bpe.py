"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks every adjoining pair up by binary
search over the sorted pair keys, takes the pair of lowest rank in each word, and merges it.
"""

import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from viewmart.llm.common import single_threaded_tokenizers, slices, text_bytes, texts_of
from viewmart.llm.pieces import PieceMemo, split_pieces

#: Distinct pieces whose ids a worker remembers; it starts anew beyond that.
MEMO_PIECES = 400_000
NEVER = np.int64(1) << 40
#: Characters whose Unicode properties are the same in all versions in use.
SETTLED = regex.compile("[\u0000-\u052f\u2000-\u206f\u3040-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(shifted)) for b in range(256)]


class MergeTable:
    """Sorted pair keys with their ranks and results, from a tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str):
        self.word_end = word_end
        self.size = max(vocab.values()) + 1
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], rank[order], made[order]
        # The lowest rank of any pair that a symbol takes part in. If that is above the rank of the
        # merge that made the symbol, all places of the merge may be done in one round.
        lowest = np.full(self.size, NEVER)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.together = lowest[self.made] > self.rank
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([vocab.get(s + word_end, -1) for s in symbols], np.int64) if word_end else self.inner

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends[sizes > 0]] = self.last[flat[ends[sizes > 0]]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_word = [], []
        while len(symbols):
            pair = np.full(len(symbols), -1, np.int64)
            same = word[1:] == word[:-1]
            pair[:-1][same] = symbols[:-1][same] * self.size + symbols[1:][same]
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            found = (self.keys[at] == pair) if len(self.keys) else np.zeros(len(pair), bool)
            rank = np.where(found, self.rank[at] if len(self.keys) else 0, NEVER)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(word)])
            live = np.repeat(best < NEVER, lengths)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_word.append(word[~live])
            chosen = live & (rank == np.repeat(best, lengths))
            places = np.flatnonzero(chosen)
            if not len(places):
                break
            # Of adjoining places of one pair, such as in "aaaa", take every other one.
            joined = np.r_[False, (np.diff(places) == 1) & (word[places[1:]] == word[places[:-1]])]
            run = np.flatnonzero(~joined)
            nth = np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))
            first = np.r_[True, word[places[1:]] != word[places[:-1]]]
            places = places[(nth % 2 == 0) & (self.together[at[places]] | first)]
            symbols[places] = self.made[at[places]]
            live[places + 1] = False
            symbols, word = symbols[live], word[live]
        if not done_word:
            return np.zeros(0, np.int64), sizes * 0
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words)).astype(np.int64)


def _lower(text: str) -> str:
    """Lower case character by character, as tokenizers do, without the final-sigma rule."""
    return text.replace("Σ", "σ").lower()


class WordBpe:
    """A word-end BPE with NFC, lower case and a splitting pattern, read from its JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        kinds = [x["type"] for x in (described.get("normalizer") or {}).get("normalizers", [])]
        split, level = described["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel" or described.get("decoder") or not described.get("added_tokens"):
            raise ValueError(f"{path} is not a lower-case word-end BPE")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.path = path
        self.byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.table = MergeTable(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {token["content"]: token["id"] for token in described.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.tokens = {i: token for token, i in [*model["vocab"].items(), *self.special.items()]}
        self._forget()
        self.memo = PieceMemo(self._learn, self._forget, MEMO_PIECES)

    @cached_property
    def library(self) -> Tokenizer:
        """For cleaning and splitting rare characters, not for merges."""
        single_threaded_tokenizers()
        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.ids, self.starts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def _words(self, piece: str) -> list[bytes]:
        """The cleaned and split words; rare characters are left to the library's Unicode tables."""
        if not SETTLED.fullmatch(piece):
            clean = self.library.normalizer.normalize_str(piece)
            return [bytes(map(self.byte_of.__getitem__, word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
        clean = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
        return [word.encode() for word in self.pattern.findall(_lower(clean))]

    def _learn(self, pieces: list[bytes]) -> None:
        """Adds the ids of the pieces. Special strings stand for themselves, before any cleaning."""
        words: list[bytes] = []
        per_piece = np.zeros(len(pieces), np.int64)
        fixed: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            before = len(words)
            for n, part in enumerate(self.special_split(piece.decode()) if b"<" in piece else (piece.decode(),)):
                if n % 2:
                    fixed[len(words)] = self.special[part]
                    words.append(b"!")
                else:
                    words += self._words(part)
            per_piece[k] = len(words) - before
        ids, sizes = self.table.encode(words)
        ends = np.r_[0, np.cumsum(sizes)]
        for at, special in fixed.items():  # "!" is one symbol, whose place the special id takes
            ids[ends[at]] = special
        done = self.starts[-1][-1]
        self.ids.append(ids.astype(np.int32))
        self.starts.append(done + ends[np.cumsum(per_piece)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 offsets of the texts."""
        data, offsets = text_bytes(texts)
        starts = split_pieces(data, offsets)
        numbers = self.memo(data, starts)
        self.ids, self.starts = [np.concatenate(self.ids)], [np.concatenate(self.starts)]
        begin = self.starts[0][numbers]
        sizes = self.starts[0][numbers + 1] - begin
        ends = np.cumsum(sizes)
        flat = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[0][flat], np.r_[0, ends][np.searchsorted(starts, offsets)]

    @cached_property
    def spelled(self) -> pa.Array:
        """The token of each id, NULL for one that no token has."""
        return pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_string())

    def decode(self, ids: pa.Array) -> pa.Array:
        """Per list of ids their tokens joined by spaces, special ones kept; NULL for a NULL list."""
        flat = ids.flatten()
        tokens = self.spelled.take(flat)  # an error for an id beyond the vocabulary
        if tokens.null_count:
            raise KeyError(flat.filter(tokens.is_null())[0].as_py())
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tokens)
        texts = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pc.if_else(ids.is_null(), None, texts) if ids.null_count else texts


@lru_cache(maxsize=2)
def _bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    bpe = _bpe(tokenizer_path)
    for batch in batches:
        for part in slices(batch):
            ids, offsets = bpe.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])
    bpe.memo.clear()


def _decoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, ids_name: str) -> Iterator[pa.RecordBatch]:
    bpe = _bpe(tokenizer_path)
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = bpe.decode(part.column(ids_name))
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row, whole texts without begin or end tokens.

    ``tokenizer_path`` must name the same file on the driver and on the executors. NULL and
    empty texts give an empty list; NULL and repeated ids keep their rows; an empty table gives
    an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, tokenizer_path)

    texts = texts_of(docs, id_col, text_col)
    return texts.mapInArrow(encode, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the tokens of its ids joined by spaces.

    A NULL list decodes to NULL, an empty one to the empty text. An id outside the vocabulary
    is an error. A column that is already called ``decoded`` is replaced.
    """
    kept = encoded.drop("decoded") if ids_col != "decoded" else encoded.withColumnRenamed("decoded", "ids")
    ids_name = ids_col if ids_col != "decoded" else "ids"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", decoded string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, tokenizer_path, ids_name)

    return kept.mapInArrow(decode, schema)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): what ``bpe_decode`` gives of ``bpe_encode``, in one pass of one Python worker a task.

    The two operators one after the other take two workers a task, each with a vocabulary of its own, and
    send all ids through the JVM.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, tokenizer_path), tokenizer_path, "ids")

    texts = texts_of(docs, id_col, text_col)
    return texts.mapInArrow(both, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def bpe_digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ``more`` from (doc_id, ids, decoded)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )
