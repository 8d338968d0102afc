"""Toxicity by weak supervision.

Many voters look at a text: each word, spelling or word beginning that labelled training rows
tie to toxicity is one. A generative model of the votes estimates how often each voter speaks
in either class and which voters only repeat each other. A linear
classifier learns from the posteriors that the model gives.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewmart.llm.common import slices, text_bytes, texts_of
from viewmart.llm.pieces import PieceMemo, split_pieces

WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
LEET = str.maketrans("0134579@$", "oieastgas")
BEGINNINGS = (4, 5, 6)
MEMO_PIECES = 400_000


def signs_of(piece: str) -> set[str]:
    """What a voter may stand for: the word, its plain spelling, and beginnings of that."""
    found = set()
    for word in WORD.findall(piece.lower()):
        if not any(c.isalpha() for c in word):
            continue
        plain = re.sub(r"(.)\1{2,}", r"\1", word.translate(LEET))
        found.add("word " + word)
        found.add("plain " + plain)
        found.update(f"begins {plain[:n]}" for n in BEGINNINGS if len(plain) > n)
    return found


def sample_rows(docs: DataFrame, labels: DataFrame, learn_from: Column, per_label: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_label`` training rows of each label, by a hash of the id."""
    marked = labels.where("label in (0, 1)").where(learn_from)
    # A sorted limit cuts each task's rows before any are sent, which a window would not.
    clean, toxic = (marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1))
    chosen = clean.unionByName(toxic)
    return docs.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows of 12 bytes


def find_voters(sample: DataFrame, most: int, min_support: int, min_lift: float) -> list[str]:
    """The signs that speak most for toxicity: at most ``most``, strongest first.

    A sign needs ``min_support`` toxic rows and ``min_lift`` times the rate among clean rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[int]] = {}
        rows = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                rows[label] += 1
                for sign in set().union(*map(signs_of, set(text.split()))) if text else ():
                    totals.setdefault(sign, [0, 0])[label] += 1
            if len(totals) > 500_000:
                yield _counted(totals)
                totals = {}
        totals[""] = rows  # no sign is empty
        yield _counted(totals)

    def _counted(totals: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(totals)), pa.array([v[0] for v in totals.values()], pa.int64()), pa.array([v[1] for v in totals.values()], pa.int64())],
            ["sign", "clean", "toxic"],
        )

    counts = sample.select("text", "label").mapInArrow(count, "sign string, clean long, toxic long")
    counts = counts.groupBy("sign").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counts.where("sign = ''").first()
    if not rows or not rows["clean"] or not rows["toxic"]:
        return []
    lift = (F.col("toxic") / rows["toxic"]) / ((F.col("clean") + 1) / rows["clean"])
    strong = counts.where("sign <> ''").where(F.col("toxic") >= min_support).withColumn("lift", lift).where(F.col("lift") >= min_lift)
    top = strong.orderBy((F.col("toxic") * F.log("lift")).desc(), "sign").limit(most).collect()
    return [row["sign"] for row in top]


class Votes:
    """Which voters speak in each text; each distinct piece of text is looked at once."""

    def __init__(self, voters: list[str]):
        self.number = {sign: k for k, sign in enumerate(voters)}
        self._forget()
        self.memo = PieceMemo(self._learn, self._forget, MEMO_PIECES)

    def _forget(self) -> None:
        self.flat, self.ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]

    def _learn(self, pieces: list[bytes]) -> None:
        found = [[self.number[s] for s in signs_of(piece.decode()) if s in self.number] for piece in pieces]
        self.flat.append(np.array([k for own in found for k in own], np.int64))
        self.ends.append(self.ends[-1][-1] + np.cumsum([len(own) for own in found]))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, voter) of each vote, a pair once."""
        data, offsets = text_bytes(texts)
        starts = split_pieces(data, offsets)
        numbers = self.memo(data, starts)
        self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        begin, end = self.ends[0][numbers], self.ends[0][numbers + 1]
        loud = np.flatnonzero(end > begin)
        if not len(loud):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = (end - begin)[loud]
        last = np.cumsum(sizes)
        voter = self.flat[0][np.arange(last[-1]) + np.repeat(begin[loud] - (last - sizes), sizes)]
        text = np.repeat(np.searchsorted(offsets, starts[loud], "right") - 1, sizes)
        pairs = np.unique(text * len(self.number) + voter)
        return pairs // len(self.number), pairs % len(self.number)


def label_model(votes: np.ndarray, marks: np.ndarray, rounds: int = 30, dependent: float = 0.3, trust: float = 0.9) -> np.ndarray:
    """Posterior probability of toxicity of each row of a 0/1 vote matrix.

    Expectation maximisation estimates each voter's rate of speaking in either class; a silent
    voter abstains. One more voter, for the clean class, speaks where all others are silent.
    Voters whose correlation within the classes is ``dependent`` or more share their weight, by
    the sum of these correlations. The rows' own marks are a voter whose accuracy is taken to be
    ``trust``, as they may be wrong too.
    """
    prior = min(max(float(marks.mean()), 0.01), 0.99)
    given = np.where(marks == 1, 1, -1) * np.log(trust / (1 - trust))
    silent = ~votes.any(axis=1)
    votes = np.c_[votes, silent]
    posterior = np.where(silent, 0.05, 0.9)
    for _ in range(rounds):
        toxic, clean = posterior.sum() + 1e-9, (1 - posterior).sum() + 1e-9
        a = (posterior @ votes + 0.5 * 0.02) / (toxic + 0.02)
        b = ((1 - posterior) @ votes + 0.5 * 0.001) / (clean + 0.001)
        a, b = np.clip(a, 1e-5, 1 - 1e-5), np.clip(b, 1e-5, 1 - 1e-5)
        # Covariance of the votes around the mean of each row's class.
        around = votes - posterior[:, None] * a - (1 - posterior)[:, None] * b
        spread = around.T @ around / len(votes)
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
        together = np.clip(spread / scale[:, None] / scale, 0, 1)
        together[together < dependent] = 0
        weight = 1 / np.maximum(together.sum(axis=1) - np.diag(together) + 1, 1)
        odds = np.log(prior / (1 - prior)) + given + votes @ (weight * np.log(a / b))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done:
            break
    return posterior


def linear_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights, the bias last, of a logistic regression on soft targets, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    weights, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + penalty * weights
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), slope)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn_from: Column, per_label: int, most_voters: int, min_support: int, min_lift: float
) -> tuple[list[str], np.ndarray]:
    """Voters and the weights of the linear classifier; the last but one counts all votes."""
    sample = sample_rows(docs, labels, learn_from, per_label)
    voters = find_voters(sample, most_voters, min_support, min_lift)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(voters)
        for batch in batches:
            for part in slices(batch):
                text, voter = votes(part.column("text"))
                per_text = np.searchsorted(text, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(voter, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, part.column("label")], ["voters", "label"])

    rows = sample.select("text", "label").mapInArrow(vote, "voters array<int>, label int")
    patterns = rows.groupBy("voters", "label").count().collect()  # of at most 2 * per_label rows
    if not voters:
        toxic, total = sum(r["count"] for r in patterns if r["label"] == 1), sum(r["count"] for r in patterns)
        share = (toxic + 0.5) / (total + 1)
        return [], np.array([0.0, np.log(share / (1 - share))])
    patterns = sorted(patterns, key=lambda r: (r["voters"], r["label"]))
    index = np.repeat(np.arange(len(patterns)), [r["count"] for r in patterns])
    matrix = np.zeros((len(patterns), len(voters)), np.float32)
    for k, row in enumerate(patterns):
        matrix[k, row["voters"]] = 1
    votes = matrix[index]
    posterior = label_model(votes, np.array([row["label"] for row in patterns])[index])
    return voters, linear_classifier(np.c_[votes, np.log1p(votes.sum(axis=1))], posterior)


def classify_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    per_label: int = 4_000,
    most_voters: int = 400,
    min_support: int = 4,
    min_lift: float = 20.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(doc_id, score) for every row: the probability that a text is toxic.

    ``learn_from`` is a condition on ``doc_id``; only labels of rows that meet it are read, and
    at most ``per_label`` rows of each label are fitted to. NULL and empty texts have no votes
    and get the score of a text without votes, as every text does if nothing could be learned.
    Whole texts of any length are scored. NULL and repeated ids keep their rows; a NULL id
    teaches nothing. Empty tables are allowed.
    """
    texts = texts_of(docs, id_col, text_col)
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    voters, weights = fit_toxicity(texts, marked, learn_from, per_label, most_voters, min_support, min_lift)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(voters) if voters else None
        for batch in batches:
            for part in slices(batch):
                odds = np.full(part.num_rows, weights[-1])
                if votes:
                    text, voter = votes(part.column("text"))
                    odds += np.bincount(text, weights[voter], part.num_rows)
                    odds += weights[-2] * np.log1p(np.bincount(text, minlength=part.num_rows))
                found = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return texts.mapInArrow(score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")
