"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are its distinct hashed tokens (presence). All grades share one weight per token; ordered thresholds
cut the score: P(grade <= k) = sigmoid(threshold[k] - score). ``score_documents`` gives the expected grade and the tail
probability P(grade >= top) for selection. Grades: 0 toxic, 1 of low quality, 2 good.

The model is fitted on a bounded sample of labelled documents (``sample`` rows, the lowest hashes of doc_id, so the same
rows at any partitioning); every document is scored on its whole text. Only tokens of at least ``min_df`` sampled documents
that pass a score test against the model without weights (``screen`` standard deviations) have weights, so the model's size
is bounded by the sample and chance words don't add up to noise in long texts.

Defined cases: null, empty and tokenless texts score 0 like a text of unknown tokens; with several labels for a document
the lowest grade holds; null labels are ignored; without labelled documents every tail probability is 1 (nothing is
rejected); of a repeated labelled doc_id one text is learnt from (the least feature set) and every row is scored; an empty
table gives an empty result; extra columns are ignored by ``score_documents`` and kept by ``select_documents``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, slices

SAMPLE, MIN_DF, GRADES, BITS, KEEP, SCREEN = 12_000, 4, 3, 24, 0.3, 3.0
TOKENS = regex.compile(r"\w+|[^\w\s]+")


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels with quality 0/1 and toxic 0/1."""
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    return labels.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def shape_tokens(tokens: list[str], distinct: int, text: str) -> list[str]:
    """Coarse facts of the whole text as tokens of their own: repetition, capitals, symbols, length."""
    n = max(1, len(tokens))
    capital = sum(map(str.isupper, tokens))
    symbols = sum(not t[0].isalnum() for t in tokens)
    return [f"\0distinct{int(10 * distinct / n)}/{min(8, n.bit_length())}", f"\0capital{int(10 * capital / n)}", f"\0symbol{int(10 * symbols / n)}", f"\0size{n.bit_length()}"]


def buckets(text: str | None) -> np.ndarray:
    """Distinct hashed tokens of a whole text."""
    tokens = TOKENS.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int32)
    kinds = {*tokens}
    low = {t.lower() for t in kinds} | {*shape_tokens(tokens, len(kinds), text or "")}
    return np.unique(np.fromiter((zlib.crc32(t.encode()) >> (32 - BITS) for t in low), np.int32, len(low)))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """Shared weights of known buckets, and increasing thresholds."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.known, self.weights, self.thresholds = known, weights, thresholds

    def score(self, features: np.ndarray) -> float:
        if not len(self.known) or not len(features):
            return 0.0
        at = np.minimum(np.searchsorted(self.known, features), len(self.known) - 1)
        return float(self.weights[at[self.known[at] == features]].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def _score_test(rows: list[np.ndarray], known: np.ndarray, y: np.ndarray, n_grades: int) -> np.ndarray:
    """For each token, the slope of the likelihood in its weight at zero, in standard deviations."""
    below = np.concatenate([[0.0], np.cumsum(np.bincount(y, minlength=n_grades)) / len(y)])  # P(grade < k)
    pull = (below[y] + below[y + 1] - 1)  # slope of the log likelihood in a document's score
    every, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.minimum(np.searchsorted(known, every), len(known) - 1)
    hit = known[at] == every
    total, square = (np.bincount(at[hit], v[owner[hit]], len(known)) for v in (pull, pull**2))
    return total / np.sqrt(np.maximum(square, 1e-12))


def _unlike(rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """One row of each set of copies of a grade (equal sets of features, by checksum), so that copies don't vote."""
    seen, out = set(), []
    for i, r in enumerate(rows):
        key = (int(y[i]), hashlib.sha256(np.ascontiguousarray(r).tobytes()).digest())
        if key not in seen:
            seen.add(key)
            out.append(i)
    return out


def likelihood(weights: np.ndarray, cuts: np.ndarray, column: np.ndarray, row: np.ndarray, y: np.ndarray, mass: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(the negative log likelihood, weighted by mass and with a squared penalty; its slope in the weights and the cuts).

    Document row[i] has the token of weights[column[i]]; cuts are the first threshold and the logarithms of the gaps.
    """
    grades = len(cuts) + 1
    score = np.bincount(row, weights[column], len(y))
    edges = np.concatenate([[-np.inf], np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])), [np.inf]])
    high, low = sigmoid(edges[y + 1] - score), sigmoid(edges[y] - score)
    p = np.maximum(high - low, 1e-9)
    d_high, d_low = high * (1 - high) / p * mass, low * (1 - low) / p * mass
    by_threshold = np.bincount(y, -d_high, grades)[: grades - 1] + np.bincount(y, d_low, grades)[1:]
    by_cut = np.cumsum(by_threshold[::-1])[::-1]
    by_cut[1:] *= np.exp(cuts[1:])
    slope = np.concatenate([np.bincount(column, (d_high - d_low)[row], len(weights)) + penalty * weights, by_cut])
    return float(-(mass * np.log(p)).sum() + penalty / 2 * (weights**2).sum()), slope


def fit(rows: list[np.ndarray], y: np.ndarray, n_grades: int = GRADES, min_df: int = MIN_DF, screen: float = SCREEN, steps: int = 250, rate: float = 0.05, penalty: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood, with the thresholds as a first one and positive gaps."""
    chosen = _unlike(rows, y)
    rows, y = [rows[i] for i in chosen], y[chosen]
    every = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    known, df = np.unique(every, return_counts=True)
    known = known[df >= min_df]
    nothing = OrdinalModel(np.zeros(0, np.int32), np.zeros(0), np.full(n_grades - 1, -50.0))
    if not len(known) or len(np.unique(y)) < 2:
        return nothing
    known = known[np.abs(_score_test(rows, known, y, n_grades)) >= screen]
    if not len(known):
        return nothing
    at = np.minimum(np.searchsorted(known, every), len(known) - 1)
    hit = known[at] == every
    column, row = at[hit], np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit]
    weights, cuts = np.zeros(len(known)), np.concatenate([[-1.0], np.zeros(n_grades - 2)])
    share = np.bincount(y, minlength=n_grades).astype(float)
    mass = (len(y) / n_grades / np.maximum(share, 1))[y] ** 0.5
    mass /= mass.sum()
    moments = [np.zeros(len(known) + n_grades - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        slope = likelihood(weights, cuts, column, row, y, mass, penalty)[1]
        moments[0] += 0.1 * (slope - moments[0])
        moments[1] += 0.01 * (slope**2 - moments[1])
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, cuts = weights - move[: len(known)], cuts - move[len(known) :]
    keep = np.abs(weights) > 1e-3
    return OrdinalModel(known[keep], weights[keep], np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


def train(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", **settings) -> OrdinalModel:
    """Fits on at most ``sample`` labelled documents; only their hashed features reach the driver, one set for each doc_id."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = graded.join(texts.select("doc_id"), "doc_id", "left_semi").select("doc_id", "grade", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            rows = [buckets(t.as_py()) for t in b["text"]]
            yield pa.record_batch([b["doc_id"], b["grade"], pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "grade", "features"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.join(F.broadcast(chosen.select("doc_id", "grade")), "doc_id").mapInArrow(run, f"doc_id {kind}, grade int, features binary")
    got = found.groupBy("doc_id", "grade").agg(F.min("features").alias("features")).collect()  # one row a chosen id, however often it is repeated
    got.sort(key=lambda r: (r["doc_id"], r["features"]))
    return fit([np.frombuffer(r["features"], np.int32) for r in got], np.array([r["grade"] for r in got], int), **settings)


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, expected_grade, tail): tail is the probability of the best grade."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j in slices(b.num_rows, byte_sizes(b[1]), 1024):
                scores = np.array([model.score(buckets(t.as_py())) for t in b[1].slice(i, j - i)])
                tails = model.tails(scores)
                yield pa.record_batch([b[0].slice(i, j - i), pa.array(scores), pa.array(tails.sum(1)), pa.array(tails[:, -1])], ["id", "score", "expected_grade", "tail"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, expected_grade double, tail double")


def select_documents(docs: DataFrame, model: OrdinalModel, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability is at least keep."""

    def run(batches):
        for b in batches:
            texts = b[b.schema.get_field_index(text_col)]
            for i, j in slices(b.num_rows, byte_sizes(texts), 1024):
                scores = np.array([model.score(buckets(t.as_py())) for t in texts.slice(i, j - i)])
                yield b.slice(i, j - i).filter(pa.array(model.tails(scores)[:, -1] >= keep))

    return docs.mapInArrow(run, docs.schema)
