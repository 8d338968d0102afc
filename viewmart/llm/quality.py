"""Quality by regularised quadratic discriminant analysis of document statistics.

Every text becomes a vector of transformed statistics in one pass. Class means and covariances
come from sums over all labelled training rows; covariances shrink towards the pooled diagonal.
A score compares the two Gaussian log densities, with the Cholesky factors computed once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viewmart.llm.common import settle, slices, text_bytes, texts_of
from viewmart.llm.pieces import hash_runs, split_pieces

KINDS = ["upper", "lower", "digit", "space", "line", "shout", "bar", "symbol", "mark", "control", "other"]


def _kind_of_byte() -> np.ndarray:
    kind = np.full(256, KINDS.index("other"), np.uint8)
    kind[:32] = kind[127] = KINDS.index("control")
    groups = {
        "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t", "line": b"\n\r", "shout": b"!?",
        "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "mark": b"\"'(),-.:;",
    }
    for name, members in groups.items():
        kind[list(members)] = KINDS.index(name)
    return kind


BYTE_KIND = _kind_of_byte()
NAMES = [*KINDS, "pieces", "distinct_pieces", "repeated_next", "distinct_lines", "long_pieces", "short_pieces", "size", "hit_symbol", "hit_upper"]


def _shares(flags: np.ndarray, owner: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.bincount(owner, flags, len(total)) / np.maximum(total, 1)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(o[new], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; an empty text has zeros."""
    data, offsets = text_bytes(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    kind = BYTE_KIND[data]
    counts = np.bincount(owner * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, -1)
    out[:, : len(KINDS)] = counts / np.maximum(sizes, 1)[:, None]

    starts = split_pieces(data, offsets)
    piece_owner = owner[starts]
    pieces = np.bincount(piece_owner, minlength=n)
    hashes = hash_runs(data, starts)
    lengths = np.diff(np.r_[starts, len(data)])
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (piece_owner[1:] == piece_owner[:-1])] if len(starts) else np.zeros(0, bool)
    at = len(KINDS)
    out[:, at] = pieces / np.maximum(sizes, 1)
    out[:, at + 1] = _distinct(hashes, piece_owner, n) / np.maximum(pieces, 1)
    out[:, at + 2] = _shares(again, piece_owner, pieces)
    line_starts = np.unique(np.r_[offsets[:-1][sizes > 0], np.flatnonzero(data[:-1] == 10) + 1 if len(data) else []]).astype(np.int64)
    lines = np.bincount(owner[line_starts], minlength=n)
    out[:, at + 3] = _distinct(hash_runs(data, line_starts), owner[line_starts], n) / np.maximum(lines, 1)
    out[:, at + 4] = _shares(lengths > 16, piece_owner, pieces)
    out[:, at + 5] = _shares(lengths < 4, piece_owner, pieces)
    odd = np.isin(kind, [KINDS.index(k) for k in ("symbol", "bar", "shout")])
    for column, flags in ((at + 7, odd), (at + 8, kind == KINDS.index("upper"))):
        hit = np.logical_or.reduceat(flags, starts) if len(starts) else np.zeros(0, bool)
        out[:, column] = _shares(hit, piece_owner, pieces)
    out = np.log1p(200 * out)
    out[:, at + 6] = np.log1p(sizes)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) for every row; NULL text is empty."""
    texts = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "x"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Discriminant:
    """Two Gaussians with cached Cholesky factors, or a constant if a class has too few rows."""

    def __init__(self, sums: dict[int, np.ndarray], shrinkage: float):
        """``sums[label]`` holds the sums of (1, x) times its own transpose."""
        self.constant, self.parts = None, []
        counts = {label: sums[label][0, 0] if label in sums else 0.0 for label in (0, 1)}
        if min(counts.values()) < 2:
            total = sum(counts.values())
            self.constant = counts[1] / total if total else 0.5
            return
        pooled = sum(self._scatter(sums[label]) for label in (0, 1)) / sum(counts.values())
        target = np.diag(np.diag(pooled) + 1e-3)
        for label in (0, 1):
            mean = sums[label][0, 1:] / counts[label]
            spread = (1 - shrinkage) * self._scatter(sums[label]) / counts[label] + shrinkage * target
            factor = np.linalg.cholesky(spread)
            constant = np.log(counts[label]) - np.log(np.diag(factor)).sum()
            self.parts.append((mean, np.linalg.inv(factor), constant))

    @staticmethod
    def _scatter(sums: np.ndarray) -> np.ndarray:
        mean = sums[0, 1:] / sums[0, 0]
        return sums[1:, 1:] - sums[0, 0] * np.outer(mean, mean)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, constant in self.parts]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_quality(features: DataFrame, labels: DataFrame, shrinkage: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """From all rows of (doc_id, x) that ``labels`` marks 0 or 1; other marks and NULL ids teach nothing."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    size = len(NAMES) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size))
        for batch in batches:
            label = batch.column("label").to_numpy()
            x = np.c_[np.ones(batch.num_rows), _rows(batch.column("x"), size - 1)]
            for k in (0, 1):
                own = x[label == k]
                sums[k] += own.T @ own
        cells = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(sums.ravel())], ["cell", "value"])

    parts = features.join(marked, "doc_id").select("label", "x").mapInArrow(add, "cell int, value double")
    sums = np.zeros(2 * size * size)
    for row in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # cells of two matrices
        sums[row["cell"]] = row["value"]
    both = sums.reshape(2, size, size)
    return Discriminant({k: both[k] for k in (0, 1) if both[k][0, 0] > 0}, shrinkage)


def quality_scores(features: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, x)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model(_rows(batch.column("x"), len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return features.mapInArrow(score, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def classify_quality(
    docs: DataFrame, labels: DataFrame, learn_from, shrinkage: float = 0.05, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, score) for every row: the probability of good quality.

    ``learn_from`` is a condition on ``doc_id``; only labels of rows that meet it are read. NULL
    and empty texts are scored by the statistics of an empty text. If fewer than two rows of
    either label can be learned from, every score is the share of label 1 (0.5 without rows).
    NULL and repeated ids keep their rows; a NULL id teaches nothing. Empty tables are allowed.
    """
    features = settle(document_statistics(docs, id_col, text_col), "document-statistics")
    return quality_scores(features, fit_quality(features.where(learn_from), labels, shrinkage))
