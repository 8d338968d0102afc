"""Language identification by unigram piece models whose segmentations are summed over.

The pieces are a fixed public vocabulary. Each language has a probability for each piece. The
probability of a word is the sum over all ways to cut it into pieces, found by the forward
algorithm; expectation maximisation with the forward-backward algorithm estimates the piece
probabilities from labelled words.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from viewmart.llm.common import carried_names, schema_of, slices, text_bytes, texts_of, with_own_names
from viewmart.llm.pieces import PieceMemo, split_pieces, sum_by_text

WORD = regex.compile(r"\p{L}+")
WORD_START = "▁"
#: Places of a word after which the masses are scaled anew; at least the length of a piece.
STEP = 24
UNKNOWN = 1e-7
#: Words whose lattices are held at once, and, where words are held whole, their places.
BLOCK = 8_000
PLACES = 330_000
MEMO_PIECES = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def marked_words(text: str) -> list[str]:
    """Lower-case letter runs of any length, each with a start mark."""
    return [WORD_START + word for word in WORD.findall(text.lower())]


class Arcs:
    """The pieces of one length in many words: start places (sorted), words, and piece numbers."""

    def __init__(self, place: np.ndarray, word: np.ndarray, number: np.ndarray, places: int):
        self.place, self.word, self.number = (x.astype(np.int32) for x in (place, word, number))
        self.edges = np.searchsorted(place, np.arange(places + 1)).tolist()

    def at(self, place: int) -> slice:
        return slice(self.edges[place], self.edges[place + 1])


class Lattice:
    """The pieces that start at each place of each word, for many words at once."""

    def __init__(self, vocabulary: list[str]):
        self.pieces = sorted({p for p in vocabulary if p and WORD.fullmatch(p.removeprefix(WORD_START) or "a") and p == p.lower()})
        self.depth = max(map(len, self.pieces), default=1)
        self.step = max(STEP, self.depth)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MIX) + ord(c) + 1) % 2**64
        return h

    def arcs(self, words: list[str], starts: int | None = None) -> tuple[np.ndarray, list[Arcs]]:
        """The words' sizes and the arcs of each length, from the first ``starts`` places if given.

        Number len(pieces) + 1 is an unknown character.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(sizes.max()) if len(sizes) else 0
        places = min(longest, starts or longest)
        codes = np.zeros((longest + self.depth, len(words)), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        column = np.repeat(np.arange(len(words)), sizes)
        codes[np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[column], column] = flat
        none, found = len(self.pieces), []
        place, word = np.nonzero(np.arange(places)[:, None] < sizes)
        value = np.zeros(len(place), np.uint64)
        for length in range(1, self.depth + 1):
            inside = place + length <= sizes[word]
            place, word, value = place[inside], word[inside], value[inside]
            value = value * MIX + codes[place + length - 1, word]
            at = np.minimum(np.searchsorted(self.hashes, value), max(none - 1, 0))
            hit = self.hashes[at] == value if none else np.zeros(len(value), bool)
            number = np.where(hit, self.order[at] if none else 0, none + 1)
            chosen = slice(None) if length == 1 else hit
            found.append(Arcs(place[chosen], word[chosen], number[chosen], places))
        return sizes, found

    @staticmethod
    def _push(mass: np.ndarray, arcs: list[Arcs], probability: np.ndarray, places: range) -> None:
        for t in places:
            for length, own in enumerate(arcs, 1):
                at = own.at(t)
                if at.start < at.stop:
                    mass[t + length, own.word[at]] += mass[t, own.word[at]] * probability[own.number[at]]

    def forward(self, sizes: np.ndarray, arcs: list[Arcs], probability: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """The probability mass that reaches each place of each word: (place, word), and as many places beyond as a piece is long.

        ``probability`` may have a column for each of several models. ``before`` is the mass that
        pieces from before the first place bring to it and the places after it.
        """
        places = len(arcs[0].edges) - 1
        mass = np.zeros((places + self.depth, len(sizes), *probability.shape[1:]))
        mass[0] = 1
        if before is not None:
            mass[: self.depth] = before
        self._push(mass, arcs, probability, range(places))
        return mass

    def word_logs(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """The natural logarithm of each word's probability in each model (a column of ``probability``).

        Words go in blocks of ``step`` places. Pieces that reach over the end of a block carry
        their mass into the next one, so every segmentation counts at every length.
        """
        logs = np.zeros((len(words), probability.shape[1]))
        active, low, before = np.arange(len(words)), 0, None
        while len(active):
            sizes, arcs = self.arcs([words[k][low : low + self.step + self.depth - 1] for k in active], self.step)
            mass = self.forward(sizes, arcs, probability, before)
            ends = sizes <= self.step
            logs[active[ends]] += np.log(mass[sizes[ends], np.flatnonzero(ends)])
            active, low = active[~ends], low + self.step
            if len(active):
                before = mass[self.step : self.step + self.depth, ~ends]
                top = before.max(axis=0)
                before, logs[active] = before / top, logs[active] + np.log(top)
        return logs

    def expected(self, sizes: np.ndarray, arcs: list[Arcs], probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used in words of these weights, over all segmentations.

        Row t of ``mass`` and ``rest`` is to be multiplied by exp of the block's row of ``up`` and ``down``.
        """
        longest, own = len(arcs[0].edges) - 1, np.arange(len(sizes))
        blocks = longest // self.step + 1
        mass, rest = (np.zeros((blocks * self.step + self.depth, len(sizes))) for _ in range(2))
        up, down = np.zeros((blocks + 1, len(sizes))), np.zeros((blocks + 1, len(sizes)))
        mass[0], rest[sizes, own] = 1, 1
        for k in range(blocks):
            low = k * self.step
            if k:
                top = mass[low : low + self.depth].max(axis=0)
                top[top == 0] = 1
                mass[low : low + self.depth] /= top
                up[k] = up[k - 1] + np.log(top)
            self._push(mass, arcs, probability, range(low, min(low + self.step, longest)))
        for k in range(blocks - 1, -1, -1):
            low = k * self.step
            for t in range(min(low + self.step, longest) - 1, low - 1, -1):
                for length, a in enumerate(arcs, 1):
                    at = a.at(t)
                    if at.start < at.stop:
                        rest[t, a.word[at]] += rest[t + length, a.word[at]] * probability[a.number[at]]
            top = rest[low : low + self.depth].max(axis=0)
            top[(top == 0) | (sizes < low + self.step)] = 1  # a word's last block stays as it is
            rest[low : low + self.step] /= top
            down[k] = down[k + 1] + np.log(top)
        total = np.log(mass[sizes, own]) + up[sizes // self.step, own]
        result = np.zeros(len(probability))
        for length, a in enumerate(arcs, 1):
            end = a.place + length
            scale = up[a.place // self.step, a.word] + down[end // self.step, a.word] - total[a.word]
            share = mass[a.place, a.word] * rest[end, a.word] * probability[a.number] * np.exp(scale)
            result += np.bincount(a.number, share * weight[a.word], len(result))
        return result

    def fit(self, counts: dict[str, int], rounds: int = 4) -> np.ndarray:
        """Piece probabilities that make the counted words likely; none and unknown come last."""
        words = sorted(counts, key=len)  # words of one block have about one length
        weight = np.array([counts[word] for word in words], np.float64)
        probability = np.full(len(self.pieces) + 2, 1.0 / max(1, len(self.pieces)))
        probability[-2:] = 0, UNKNOWN
        cuts = [0]
        for k, word in enumerate(words):
            if k - cuts[-1] >= BLOCK or (k > cuts[-1] and (len(word) + 1) * (k + 1 - cuts[-1]) > PLACES):
                cuts.append(k)
        blocks = [(self.arcs(words[a:b]), weight[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True) if a < b]
        for _ in range(rounds):
            expected = np.zeros(len(probability))
            for (sizes, arcs), w in blocks:
                expected += self.expected(sizes, arcs, probability, w)
            expected[-2:] = 0
            smooth = expected + 0.01
            probability[:-2] = (smooth / smooth[:-2].sum())[:-2] if len(self.pieces) else 0
            probability[-2:] = 0, UNKNOWN
        return probability


@lru_cache(maxsize=2)
def _lattice(vocabulary_path: str) -> Lattice:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
    return Lattice([model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)])


class Scorer:
    """Log probabilities of texts in every language, each distinct piece of text computed once."""

    def __init__(self, lattice: Lattice, probabilities: np.ndarray):
        self.lattice, self.probabilities = lattice, np.ascontiguousarray(probabilities.T)
        self._forget()
        self.memo = PieceMemo(self._learn, self._forget, MEMO_PIECES)

    def _forget(self) -> None:
        self.values = [np.zeros((0, self.probabilities.shape[1] + 1))]

    def _learn(self, pieces: list[bytes]) -> None:
        """Adds a row per piece: the number of its words, then its log probability by language."""
        words, own = [], np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            found = marked_words(piece.decode())
            own[k] = len(found)
            words += found
        logs = np.zeros((len(words) + 1, self.probabilities.shape[1]))
        by_size = sorted(range(len(words)), key=lambda k: len(words[k]))
        for k in range(0, len(words) if logs.shape[1] else 0, BLOCK):
            chosen = np.array(by_size[k : k + BLOCK])
            logs[chosen + 1] = self.lattice.word_logs([words[c] for c in chosen], self.probabilities)
        total, ends = np.cumsum(logs, axis=0), np.cumsum(own)
        self.values.append(np.c_[own, total[ends] - total[ends - own]])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(texts)
        starts = split_pieces(data, offsets)
        numbers = self.memo(data, starts)
        self.values = [np.concatenate(self.values)]
        return sum_by_text(self.values[0][numbers], starts, offsets)


def fit_languages(
    docs: DataFrame, vocabulary_path: str, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, np.ndarray]:
    """Piece probabilities by language, from at most ``per_language`` documents of each.

    The documents are those with the smallest hash of their id. Rows without a language or an
    id teach nothing; a language whose documents hold no word is not learned.
    """
    labelled = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")
    ).where("doc_id is not null and lang is not null")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_language)
    # Broadcast: at most per_language ids for each language.
    sample = labelled.join(F.broadcast(chosen.drop("n").distinct()), ["doc_id", "lang"], "left_semi")

    def fit(table: pa.Table) -> pa.Table:
        counts: dict[str, int] = {}
        for text in table["text"].to_pylist():
            for word in marked_words(text):
                counts[word] = counts.get(word, 0) + 1
        probability = _lattice(vocabulary_path).fit(counts) if counts else []
        return pa.table({"lang": table["lang"][:1], "probability": pa.array([list(probability)], pa.list_(pa.float64()))})

    rows = sample.groupBy("lang").applyInArrow(fit, "lang string, probability array<double>").collect()
    return {row["lang"]: np.array(row["probability"]) for row in sorted(rows, key=lambda row: row["lang"]) if row["probability"]}


def identify_languages(
    docs: DataFrame,
    vocabulary_path: str,
    languages: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, lang_pred, score, has_letter) for every row, and the columns of ``docs`` that ``carry`` names.

    ``score`` is the posterior probability of ``lang_pred`` when all languages are equally
    likely beforehand; of equal ones the first by name is taken. NULL text, text without a
    letter, and any text when no language was learned, give ``und`` and 0; ``has_letter`` tells
    the last from the others. Whole texts of any length are scored; NULL and repeated ids keep
    their rows; an empty table gives an empty result.
    """
    names = list(languages)
    model = np.array([languages[name] for name in names]) if names else np.zeros((0, 0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages
    texts, passed = texts_of(docs, id_col, text_col, carry), ["doc_id", *carried_names(carry)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(_lattice(vocabulary_path), shared.value)
        for batch in batches:
            for part in slices(batch):
                values = scorer(part.column("text"))
                letter = values[:, 0] > 0
                if names:
                    logs = values[:, 1:]
                    best = logs.argmax(axis=1)
                    sure = 1 / np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700)).sum(axis=1)
                    known = letter
                else:
                    best, sure, known = np.zeros(len(values), int), np.zeros(len(values)), np.zeros(len(values), bool)
                pred = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                found = [pa.array(pred, pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(letter)]
                yield pa.RecordBatch.from_arrays([*map(part.column, passed), *found], [*passed, "lang_pred", "score", "has_letter"])

    scored = texts.mapInArrow(score, schema_of(texts, passed) + ", lang_pred string, score double, has_letter boolean")
    return with_own_names(scored, carry)
