"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1.  Random indexing over the whole corpus: every word bucket has a fixed sparse index vector of +-1;
    the vector of a word is the sum of the index vectors of the words around it (and its own). Besides
    the words themselves, each token has a second "word" for its written form (classes of its
    characters, length) and a third one if it repeats the token before it. Tasks add up a table of
    fixed size (BUCKETS x DIMS); the tables are summed by bucket in Spark.
2.  A document is the mean of its words' vectors (frequent words count less) beside the mean of its
    forms' vectors.
3.  A two-layer numpy network learns the label from at most TRAIN_ROWS labelled documents, its
    probabilities are calibrated by one temperature on rows kept back from training.

Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.labelled import training_rows
from churnkit.llm.tables import as_bytes, binary_array, extended
from churnkit.llm.wordhash import SPACE_SEPARATED, chunks, mix64, word_hashes, word_spans

#: labelled documents learned from, at most
TRAIN_ROWS = 20_000
#: buckets of words and of written forms (plus one for repeats); length and non-zeros of a vector
WORDS, FORMS, DIMS, NONZERO = 8192, 512, 64, 4
BUCKETS = WORDS + FORMS + 1
HIDDEN, EPOCHS, SEED = 32, 40, 7
#: texts pooled at once
TEXTS = 128

_bit = np.zeros(256, dtype=np.uint32)
_bit[97:123], _bit[65:91], _bit[48:58], _bit[128:] = 1, 2, 4, 8
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _bit[_c] = 1 << (4 + _i % 28)

_code = mix64(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(11)).reshape(BUCKETS, NONZERO)
INDEX_AT = (_code % np.uint64(DIMS)).astype(np.int64)
INDEX_SIGN = np.where((_code >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def token_buckets(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, form bucket, repeats the token before, tokens per text) of all tokens of a batch."""
    data, starts, ends, counts = word_spans(raw, SPACE_SEPARATED, lower=False)
    code = word_hashes(data, starts, ends)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), counts
    classes = np.bitwise_or.reduceat(np.append(_bit[data], np.uint32(0)), np.stack([starts, ends], axis=1).ravel())[::2]
    form = mix64(classes.astype(np.uint64) * np.uint64(64) + np.minimum(ends - starts, 32).astype(np.uint64) // np.uint64(4))
    first = np.zeros(len(code), dtype=bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[1:] == code[:-1]) & ~first[1:]
    return (code % np.uint64(WORDS)).astype(np.int64), WORDS + (form % np.uint64(FORMS)).astype(np.int64), again, counts


def context_table(raw: list[bytes], out: np.ndarray) -> None:
    """Add the contexts of a batch to `out` (BUCKETS x (DIMS + 1)); the last column counts tokens."""
    word, form, again, counts = token_buckets(raw)
    if not len(word):
        return
    text = np.repeat(np.arange(len(counts)), counts)
    flat = np.zeros(BUCKETS * DIMS)
    repeat = np.full(int(again.sum()), BUCKETS - 1)
    pairs = [(word, word), (word, form), (form, form), (repeat, repeat)]
    near = text[1:] == text[:-1]
    for a, b in ((word, word), (word, form), (form, form)):
        pairs += [(a[1:][near], b[:-1][near]), (a[:-1][near], b[1:][near])]
    for target, context in pairs:
        base = target * DIMS
        for t in range(NONZERO):
            flat += np.bincount(base + INDEX_AT[context, t], weights=INDEX_SIGN[context, t], minlength=len(flat))
    out[:, :DIMS] += flat.reshape(BUCKETS, DIMS)
    out[:, DIMS] += np.bincount(np.concatenate([word, form, repeat]), minlength=BUCKETS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets over the whole corpus, scaled: (BUCKETS, DIMS) float32."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIMS + 1))
        for batch in batches:
            raw = as_bytes(batch.column(0))
            for i, j in chunks(raw, 2_000_000):
                context_table(raw[i:j], total)
        used = np.flatnonzero(total[:, DIMS])
        yield pa.RecordBatch.from_arrays([pa.array(used), binary_array(total[used].astype(np.float32))], names=["bucket", "vector"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(v, dtype=np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()), binary_array(total.values())], names=["bucket", "vector"])

    schema = "bucket long, vector binary"
    parts = docs.select("text").mapInArrow(add, schema)
    out = np.zeros((BUCKETS, DIMS + 1))
    for row in parts.repartition("bucket").mapInArrow(merge, schema).toLocalIterator():
        out[row.bucket] = np.frombuffer(row.vector, dtype=np.float64)
    vectors, seen = out[:, :DIMS], out[:, DIMS:]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = seen / max(1.0, seen[:WORDS].sum())
    vectors[:WORDS] *= (1e-3 / (1e-3 + share))[:WORDS]
    return vectors.astype(np.float32)


def document_vectors(raw: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of texts: word part, form part, log of the number of tokens."""
    out = np.zeros((len(raw), 2 * DIMS + 1), dtype=np.float32)
    for i, j in [(a, min(a + TEXTS, z)) for x, z in chunks(raw, 1_000_000) for a in range(x, z, TEXTS)]:
        word, form, again, counts = token_buckets(raw[i:j])
        if not len(word):
            continue
        row = np.repeat(np.arange(j - i), counts) * BUCKETS
        held = np.bincount(np.concatenate([row + word, row + form, row[again] + BUCKETS - 1]), minlength=(j - i) * BUCKETS)
        held = held.reshape(j - i, BUCKETS).astype(np.float32) / np.maximum(counts, 1).astype(np.float32)[:, None]
        out[i:j, :DIMS] = held[:, :WORDS] @ vectors[:WORDS]
        out[i:j, DIMS:2 * DIMS] = held[:, WORDS:] @ vectors[WORDS:]
        out[i:j, -1] = np.log1p(counts) / 10
    return out


class Network:
    """tanh hidden layer and logistic output on standardised inputs; `temperature` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = (float(y.sum()) + 1) / (len(y) + 2)
        self.known = len(np.unique(y)) == 2
        self.temperature = 1.0
        if not self.known:
            return
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        order = draw.permutation(len(x))
        back = order[:max(1, len(x) // 5)] if len(x) >= 20 else order
        learn = order[len(x) // 5:] if len(x) >= 20 else order
        self.w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(EPOCHS):
            for own in np.array_split(draw.permutation(learn), max(1, len(learn) // 256)):
                step += 1
                h = np.tanh(x[own] @ self.w[0] + self.w[1])
                p = _logistic(h @ self.w[2] + self.w[3])
                d = (p - y[own]) / len(own)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                for k, g in enumerate((x[own].T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()]))):
                    g = g + 1e-4 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.003 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        logit, truth = self._logit(x[back]), y[back]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -logit, logit) / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.rate)
        return _logistic(self._logit((x - self.mean) / self.scale) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_quality(docs: DataFrame, labels: DataFrame, learn_from, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors over all documents, and the network fitted on labelled ones (`learn_from`: which ids)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = binary_array(document_vectors(as_bytes(batch.column(0)), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), x], names=["y", "doc_id", "x"])

    sample = training_rows(docs, labels, "quality", learn_from, rows).select("text", "y", "doc_id")
    found = sorted((r.doc_id, r.y, bytes(r.x)) for r in sample.mapInArrow(pool, "y int, doc_id long, x binary").toLocalIterator())
    x = np.stack([np.frombuffer(f[2], dtype=np.float32) for f in found]).astype(np.float64) if found else np.zeros((0, 2 * DIMS + 1))
    return vectors, Network(x, np.array([f[1] for f in found], dtype=np.float64))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], out: str = "score") -> DataFrame:
    """`docs` plus `out`: probability of label 1 for each text (null counts as empty); a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, kept, schema = extended(docs, f"{out} double")
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            p = network.probabilities(document_vectors(as_bytes(batch.column(at)), vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, type=pa.float64())], names=[*kept, out])

    return rows.mapInArrow(run, schema)
