"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams (lengths 3 to 8, word boundaries included)
of its words, hashed to 2^20 numbers. For each feature, the log ratio of its smoothed document
frequency in the two classes is its scale; a logistic regression is learned on the scaled features
that speak for toxicity. Scales and weights come from at most TRAIN_ROWS labelled documents; a
score needs only the text, word by word, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.labelled import training_rows
from churnkit.llm.tables import as_bytes, binary_array, extended
from churnkit.llm.wordhash import BYTE_CODE, INVERSE, POWER, _powers, byte_class, chunks, word_spans

#: labelled documents learned from, at most
TRAIN_ROWS = 20_000
LENGTHS, FEATURES, SHIFT = (3, 4, 5, 6, 7, 8), 1 << 20, np.uint64(64 - 20)
#: documents that stand for what was not seen
PRIOR = 10.0
#: features whose log ratio is smaller than this are left out of the regression (those that speak for the
#: other class too: ordinary words don't excuse a toxic one, however many there are)
LEAST_RATIO = 1.0
STEPS, PENALTY = 150, 1e-4

#: words are runs of letters, digits and all characters beyond ASCII
LETTERS = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def gram_features(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (place, feature) of every character n-gram of a batch, and where its texts end.

    Letters are lower-cased; anything but words counts as a space, and an n-gram may begin or end
    with a space but has none inside. Texts are parted by spaces too.
    """
    data, starts, ends, _ = word_spans(raw, LETTERS)
    data = np.where(LETTERS[data], data, np.uint8(32))
    stops = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    blank = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(data == 32, out=blank[1:])
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers(POWER, len(data)), out=running[1:])
    back = _powers(INVERSE, len(data))
    for n in LENGTHS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        at = np.flatnonzero(blank[n - 1:m + n - 1] == blank[1:m + 1])
        code = (running[at + n] - running[at]) * back[at] + np.uint64(n)
        feature = (code * np.uint64(0x9E3779B97F4A7C15)) >> SHIFT
        yield at, feature.astype(np.int64), stops


def text_features(raw: list[bytes], keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Distinct features of each text (only those marked in `keep`, if given)."""
    for i, j in chunks(raw, 1_000_000):
        pairs = []
        for at, feature, stops in gram_features(raw[i:j]):
            if keep is not None:
                good = keep[feature]
                at, feature = at[good], feature[good]
            pairs.append(np.searchsorted(stops, at, side="right") * np.int64(FEATURES) + feature)
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        cut = np.searchsorted(pairs, np.arange(j - i + 1) * np.int64(FEATURES))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield pairs[a:b] % FEATURES


def log_ratios(seen: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Naive Bayes log-count ratio of each feature from the documents of both classes that hold it.

    PRIOR documents, shared out as the classes are, stand for what was not seen, so a feature has a
    ratio near zero until there is evidence. Ratios below LEAST_RATIO are zero.
    """
    n0, n1 = max(n0, 1), max(n1, 1)
    p = (seen[1] + PRIOR * n1 / (n0 + n1)) / n1
    q = (seen[0] + PRIOR * n0 / (n0 + n1)) / n0
    ratio = np.log(p) - np.log(q)
    ratio[ratio < LEAST_RATIO] = 0
    return ratio


class RatioModel:
    """Scales and weights of the features; `score` is a probability."""

    def __init__(self, ratio: np.ndarray, rows: list[np.ndarray], y: np.ndarray):
        self.rate = (float(y.sum()) + 1) / (len(y) + 2)
        self.known = len(np.unique(y)) == 2
        weight = np.ones(len(ratio))
        self.bias = np.log(self.rate / (1 - self.rate))
        self.value = np.zeros(len(ratio), dtype=np.float32)
        if not self.known:
            return
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        m, v = np.zeros(len(ratio)), np.zeros(len(ratio))
        bm = bv = 0.0
        scale = ratio[at]
        for step in range(1, STEPS + 1):
            z = self.bias + np.bincount(own, weights=scale * weight[at], minlength=len(rows))
            d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(rows)
            g = np.bincount(at, weights=scale * d[own], minlength=len(ratio)) + PENALTY * weight
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            weight -= 0.03 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
            gb = float(d.sum())
            bm, bv = 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
            self.bias -= 0.03 * (bm / (1 - 0.9 ** step)) / (np.sqrt(bv / (1 - 0.99 ** step)) + 1e-9)
        self.value = (ratio * weight).astype(np.float32)

    def score(self, raw: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        if not self.known:
            return np.full(len(raw), self.rate)
        out = np.array([self.value[f].sum(dtype=np.float64) for f in text_features(raw, self.value != 0)])
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_from, rows: int = TRAIN_ROWS) -> RatioModel:
    """Model learned from labelled documents (`learn_from`: condition on doc_id)."""
    sample = training_rows(docs, labels, "toxic", learn_from, rows)
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FEATURES), dtype=np.int64)
        for batch in batches:
            for y, own in zip(batch.column(1).to_pylist(), text_features(as_bytes(batch.column(0))), strict=True):
                seen[int(y == 1), own] += 1
        for y in (0, 1):
            at = np.flatnonzero(seen[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y, dtype=np.int32)), pa.array(at), pa.array(seen[y, at])], names=["y", "feature", "n"])

    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    seen = np.zeros((2, FEATURES))
    table = sample.select("text", "y").mapInArrow(count, "y int, feature long, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"))
    for batch in table.toArrow().to_batches():
        at = batch.column(0).to_numpy()
        seen[0, at], seen[1, at] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    ratio = log_ratios(seen, n0, n1)
    shared = spark.sparkContext.broadcast(ratio != 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [f.astype(np.int32) for f in text_features(as_bytes(batch.column(0)), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), binary_array(own)], names=["y", "doc_id", "x"])

    found = sorted((r.doc_id, r.y, bytes(r.x)) for r in sample.select("text", "y", "doc_id").mapInArrow(features, "y int, doc_id long, x binary").toLocalIterator())
    return RatioModel(ratio, [np.frombuffer(f[2], dtype=np.int32) for f in found], np.array([f[1] for f in found], dtype=np.float64))


def score_toxicity(docs: DataFrame, model: RatioModel, out: str = "score") -> DataFrame:
    """`docs` plus `out`: probability of label 1 for each text (null counts as empty); a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, kept, schema = extended(docs, f"{out} double")
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, type=pa.float64())], names=[*kept, out])

    return rows.mapInArrow(run, schema)
