"""Toxicity by subword bags: n-gram vectors averaged over words and documents, and a linear softmax, trained jointly.

A word's vector is the mean of the vectors of its character n-grams (hashed to ``BUCKETS`` rows), a document's that
of its distinct words, and a softmax over both classes stands on it. As all of it is linear after training, a word
adds one number to a document's score, so whole texts of any length are scored by looking up words. Misspelt or
inflected words share n-grams with those seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
DIMENSIONS = 8
TOXIC_ROWS, CLEAN_ROWS = 1_500, 3_000  # labelled documents the model is trained on, at most
STEPS, BATCH, RATE, SCALE = 300, 128, 0.02, 50.0
THRESHOLD = 0.3


def grams(word: str) -> list[str]:
    """The word between marks, and its n-grams."""
    marked = f"<{word}>"
    return [marked, *[marked[i : i + k] for k in GRAMS for i in range(len(marked) - k + 1)]]


def _bucket(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram) % BUCKETS


def distinct_words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def bag(text: str | None, bucket: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares (at most ``BUCKETS`` pairs); none without words."""
    found = distinct_words(text)
    total: dict[int, float] = {}
    for word in sorted(found):
        own = grams(word)
        for g in own:
            b = bucket[g]
            total[b] = total.get(b, 0.0) + 1 / len(own)
    at = np.array(sorted(total), dtype=np.int32)
    return at, np.array([total[b] for b in at.tolist()], dtype=np.float32) / max(len(found), 1)


class BagModel:
    """Bucket vectors ``E``, softmax weights ``W`` and bias ``b``; Adam on mini-batches of sparse bags."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.E, self.W, self.b = rng.normal(size=(BUCKETS, DIMENSIONS)) * 0.1, rng.normal(size=(DIMENSIONS, 2)) * 0.1, np.zeros(2)
        params, step = [self.E, self.W, self.b], 0
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        while len(bags) and step < STEPS:
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                picked = order[lo : lo + BATCH]
                at, share = np.concatenate([bags[i][0] for i in picked]), SCALE * np.concatenate([bags[i][1] for i in picked])
                doc = np.repeat(np.arange(len(picked)), [len(bags[i][0]) for i in picked])
                rows = self.E[at] * share[:, None]
                hidden = np.stack([np.bincount(doc, rows[:, k], len(picked)) for k in range(DIMENSIONS)], axis=1)
                z = hidden @ self.W + self.b
                error = np.exp(z - z.max(axis=1, keepdims=True))
                error /= error.sum(axis=1, keepdims=True)
                error[np.arange(len(picked)), labels[picked]] -= 1
                error /= len(picked)
                back = error @ self.W.T
                slopes = [np.stack([np.bincount(at, back[doc, k] * share, BUCKETS) for k in range(DIMENSIONS)], axis=1), hidden.T @ error, error.sum(axis=0)]
                step += 1
                pace = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(params, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= pace * m / (np.sqrt(v) + 1e-8)

    def weights(self) -> tuple[np.ndarray, float]:
        """What one unit of each bucket's share adds to the log odds, and the bias."""
        return SCALE * (self.E @ (self.W[:, 1] - self.W[:, 0])), float(self.b[1] - self.b[0])


def held_out(doc_id: Column) -> Column:
    """True for ids whose CRC-32 (as text) is 2 modulo 4; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``doc_id, toxic`` of at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows of least hash, none held out."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(10), "doc_id"), F.col("doc_id")]
    return marks.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(marks.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> BagModel:
    """The model of a bounded sample of labelled documents; their bags are made on the executors."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Memo(_bucket)
        for batch in batches(rows):
            made = [bag(t, bucket) for t in batch.column(1).to_pylist()]
            out = [batch.column(0), batch.column(2), pa.array([m[0].tobytes() for m in made], pa.binary()), pa.array([m[1].tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "toxic", "at", "share"])

    picked = F.broadcast(training_rows(labels, id_col, label_col))  # bounded by the two limits
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(picked, "doc_id").select("doc_id", "text", "toxic")
    rows = sorted(texts.mapInArrow(run, "doc_id long, toxic int, at binary, share binary").collect())
    bags = [(np.frombuffer(bytes(r["at"]), np.int32), np.frombuffer(bytes(r["share"]), np.float32)) for r in rows]
    return BagModel(bags, np.array([r["toxic"] for r in rows], dtype=np.int64))


def score_texts(docs: DataFrame, model: BagModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``; a text without words has the bias alone."""
    weights, bias = model.weights()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        of_gram = Memo(lambda g: float(w[_bucket(g)]), limit=500_000).__getitem__

        def of_word(word: str) -> float:
            own = grams(word)
            return sum(map(of_gram, own)) / len(own)

        look = Memo(of_word, limit=700_000).__getitem__
        for batch in batches(rows):
            score = []
            for text in batch.column(1).to_pylist():
                found = distinct_words(text)
                odds = bias + (math.fsum(map(look, found)) / len(found) if found else 0.0)
                score.append(1 / (1 + np.exp(-np.clip(odds, -700, 700))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
