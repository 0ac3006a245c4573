"""Language identification with a blended-spectrum string kernel.

phi(text) is the set of its hashed character 1-, 2- and 3-grams; k(x, y) = |phi(x) & phi(y)| / sqrt(|phi(x)| |phi(y)|).
A Nystroem map over landmark texts and one-versus-rest kernel ridge regression give one weight per landmark and language;
texts are scored in batches: presence matrix times landmark matrix, times weights.

Fitted on a bounded sample (``sample`` documents a language, the lowest hashes of id and text; of them ``landmarks`` in all).
Every document is predicted on its whole text.

Defined cases: null text and text without letters are ``und`` with score 0; so is every text when there is nothing to learn
from; rows of a null id or language are not learnt from; ties go to the language first in order; equal texts get equal
results, also under repeated or null ids; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_sizes, slices

BITS, SAMPLE, LANDMARKS, RIDGE = 15, 500, 128, 1e-2
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Odd multipliers of the hash.
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def presence(text: str | None) -> np.ndarray | None:
    """phi of a whole text as booleans; None if it has no letters."""
    if not text or not LETTER.search(text):
        return None
    c = np.frombuffer(f" {OTHER.sub(' ', text.lower())} ".encode("utf-32-le"), np.uint32)
    out = np.zeros(1 << BITS, bool)
    h = np.zeros(len(c), np.uint32)
    for n, m in enumerate(MIX):
        h = (h[: len(c) - n] ^ c[n:]) * m
        h ^= h >> np.uint32(15)
        out[h >> np.uint32(32 - BITS)] = True
    return out


class LanguageModel:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        label, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [presence(t) for t in texts]
        has = [i for i, r in enumerate(rows) if r is not None]
        if has and self.languages:
            found = kernel(np.stack([rows[i] for i in has]), self.landmarks) @ self.weights
            for i, s in zip(has, found, strict=True):
                best = int(np.argmax(s))
                label[i], score[i] = self.languages[best], min(1.0, max(0.0, (1 + float(s[best])) / 2))
        return label, score


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return (x @ landmarks.T / np.sqrt(np.maximum(1, x.sum(1)))[:, None]).astype(np.float64)


def fit(rows: list[np.ndarray], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    languages = sorted({*langs})
    if not languages:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0)))
    turn: dict[str, int] = {}
    order = []  # landmarks take turns over the languages
    for i, lang in enumerate(langs):
        order.append((turn.setdefault(lang, 0), lang, i))
        turn[lang] += 1
    chosen = [i for _, _, i in sorted(order)[:n_landmarks]]
    marks = np.stack([rows[i] for i in chosen]).astype(np.float32)
    marks /= np.sqrt(np.maximum(1, marks.sum(1)))[:, None]
    inner = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])  # Nystroem: z = k(x, landmarks) @ whiten
    z = np.concatenate([kernel(np.stack(rows[i : i + 256]), marks) for i in range(0, len(rows), 256)]) @ whiten
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    beta = np.linalg.solve(z.T @ z + ridge * len(rows) * np.eye(z.shape[1]) / max(1, z.shape[1]), z.T @ y)
    return LanguageModel(languages, marks, whiten @ beta)


def train(docs: DataFrame, sample: int = SAMPLE, n_landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most ``sample`` documents of each language; packed presence bits of these reach the driver.

    Rows come from a hash threshold that leaves some four times the sample of each language, so that a language of a third of
    all rows sends few to the task that ranks it; of these, the ``sample`` lowest hashes. Equal rows count once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    # a row a language: about how many rows differ, so that repeated rows neither fill nor thin out the sample
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return fit([], [], n_landmarks)
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 4 * sample / n))])
    few = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.element_at(limits, F.col("lang"))).distinct()
    turn = Window.partitionBy("lang").orderBy("h", "id", "text")
    chosen = few.withColumn("n", F.row_number().over(turn)).filter(F.col("n") <= sample)

    def run(batches):
        for b in batches:
            bits = [presence(t.as_py()) for t in b["text"]]
            yield pa.record_batch([b["h"], b["lang"], pa.array([None if x is None else np.packbits(x).tobytes() for x in bits], pa.binary())], ["h", "lang", "bits"])

    got = [r for r in chosen.select("h", "lang", "text").mapInArrow(run, "h long, lang string, bits binary").collect() if r["bits"] is not None]
    got.sort(key=lambda r: (r["h"], r["lang"], r["bits"]))
    return fit([np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool) for r in got], [r["lang"] for r in got], n_landmarks)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j in slices(b.num_rows, byte_sizes(b[1]), 128):
                label, score = model.predict(b[1].slice(i, j - i).to_pylist())
                yield pa.record_batch([b[0].slice(i, j - i), pa.array(label, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double")
