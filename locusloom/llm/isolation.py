"""Quality rules, and an isolation forest on their statistics.

Counts of each text are taken once. A forest of random splits is grown on a bounded sample of documents; a
document's path is short, and its score near 1, if few splits set it apart. The verdict's threshold comes from
labelled rows: the score that separates the labels best while it rejects at most ``MAX_GOOD_LOST`` of the good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, window_hashes, word_hashes, words, written

SAMPLE_ROWS = 8_192  # rows the forest is grown on, at most
TREES = 200
TREE_ROWS = 256
BINS = 20_000  # steps of the score when thresholds are compared
MAX_GOOD_LOST = 0.002
FEW_CHARS = 300  # rates of short texts are drawn to zero: so many plain characters are added
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "lone_mark_rate", "bang_rate"]

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def rule_counts(text: str | None) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``RATES`` of one text; all zero without text."""
    found = words(text)
    n = len(found)
    if n == 0:
        symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
        return [0, 0, symbols, 0, 0], [0.0] * len(RATES)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > 5:
        _, where, times = np.unique(window_hashes(word_hashes(found), 5), return_inverse=True, return_counts=True)
        twice = times[where] >= 2
        if twice.any():
            change = np.zeros(n + 1, dtype=np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + 5, -1)
            repeated = int((np.cumsum(change[:n]) > 0).sum())
    b = np.frombuffer(text.encode(), dtype=np.uint8)
    seen_bytes = np.bincount(b, minlength=256)
    letters = int(seen_bytes[0x41:0x5B].sum() + seen_bytes[0x61:0x7B].sum())
    lone = sum(1 for w in found if len(w) == 1 and _MARKS[w[0]])
    rates = [
        math.log((chars + FEW_CHARS) / (n + FEW_CHARS / 6)),
        math.log1p(100 * symbols / (n + FEW_CHARS / 6)),
        dup / (lines + 3),
        repeated / (n + FEW_CHARS / 6),
        seen_bytes[0x41:0x5B].sum() / (letters + FEW_CHARS),
        seen_bytes[_MARKS].sum() / (chars + FEW_CHARS),
        lone / (n + FEW_CHARS / 6),
        text.count("!") / (n + FEW_CHARS / 6),
    ]
    return [n, chars, symbols, dup, repeated], [float(r) for r in rates]


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``COUNTS`` and ``rates`` (array) of every whole text, row by row. NULL: no words."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("rates", pa.list_(pa.float64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            got = [rule_counts(t) for t in batch.column(1).to_pylist()]
            out = [batch.column(0), *[pa.array([g[0][i] for g in got], type=pa.int64()) for i in range(len(COUNTS))], pa.array([g[1] for g in got], type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", rates array<double>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def _mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path of an unsuccessful search among ``n`` rows of a binary search tree."""
    n = np.maximum(n, 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: split column, split value, children, and the path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 6):
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.norm = float(_mean_path(float(size))) or 1.0
        self.depth = max(1, math.ceil(math.log2(max(size, 2)))) + 2
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees if len(rows) else 0)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, value, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            me = len(column)
            for x in (column, value, left, right):
                x.append(0)
            path.append(0.0)
            low, high = part.min(axis=0), part.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) <= 1 or not len(open_columns):
                column[me], left[me], right[me] = -1, me, me
                path[me] = depth + float(_mean_path(float(len(part))))
                return me
            c = int(rng.choice(open_columns))
            v = rng.uniform(low[c], high[c])
            below = part[:, c] < v
            column[me], value[me] = c, v
            left[me] = node(part[below], depth + 1)
            right[me] = node(part[~below], depth + 1)
            return me

        node(rows, 0)
        return np.array(column), np.array(value), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over its expectation: near 1 for rows that are soon alone."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for column, value, left, right, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                c = column[at]
                go_left = rows[every, np.maximum(c, 0)] < value[at]
                at = np.where(go_left, left[at], right[at])
            total += path[at]
        return 2.0 ** (-(total / len(self.trees)) / self.norm)


def grow_forest(stats: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest on the ``sample_rows`` documents of least hash (all, if there are fewer) that have words."""
    picked = stats.filter("n_words > 0").select(F.xxhash64(F.lit(6), "doc_id", "n_words").alias("h"), "doc_id", "rates").orderBy("h", "doc_id", "rates").limit(sample_rows)
    rows = [r.rates for r in picked.collect()]
    return Forest(np.array(rows, dtype=float).reshape(len(rows), len(RATES)))


def forest_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``anomaly`` in 0..1; 0 for documents without words. The forest's size is a constant."""
    columns = [c for c in stats.columns if c != "rates"]
    schema_of = stats.select(*columns).schema
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4 << 20):
            table = pa.Table.from_batches([batch])
            rates = np.array(table["rates"].to_pylist(), dtype=float).reshape(batch.num_rows, len(RATES))
            score = np.where(np.array(table["n_words"].to_pylist()) > 0, shared.value.score(rates), 0.0)
            yield from table.select(columns).append_column("anomaly", pa.array(score)).to_batches()

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema_of) + ", anomaly double"
    return stats.mapInArrow(run, ddl)


def calibrated_threshold(scored: DataFrame, labels: DataFrame, *, max_good_lost: float = MAX_GOOD_LOST, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """Score above which a document is rejected: best separation of labels with few good rows lost.

    All labelled rows count, folded to ``BINS`` steps of the score before they reach the driver. Without labels of
    both kinds nothing is rejected (2.0).
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter("good IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"))
    steps = (
        scored.filter("n_words > 0 AND NOT base_failed")
        .join(marks, "doc_id")
        .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("step"))
        .agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad"))
        .collect()
    )
    good, bad = sum(r.good for r in steps), sum(r.bad for r in steps)
    if not good or not bad:
        return 2.0
    best, threshold, lost, caught = 0.0, 2.0, 0, 0
    for r in sorted(steps, key=lambda r: -r.step):
        lost, caught = lost + r.good, caught + r.bad
        gain = caught / bad - lost / good
        if lost / good <= max_good_lost and gain > best:
            best, threshold = gain, r.step / BINS
    return threshold


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``COUNTS``, ``base_failed``, ``kept``, ``anomaly``.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in five-word windows that the text repeats.
    ``kept`` is false for those, else the forest's verdict. An empty or NULL text fails. Rows of one id are judged
    each by its own text.
    """
    stats = written(text_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    scored = forest_scores(stats, grow_forest(stats)).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    threshold = calibrated_threshold(scored, labels, label_col=label_col)
    kept = ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold))
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "anomaly")
