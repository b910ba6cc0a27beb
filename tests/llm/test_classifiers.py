"""Quality and toxicity classifiers: held-out accuracy, and awkward tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.llm.labelled import fold
from churnkit.llm.quality import Network, fit_quality, score_quality
from churnkit.llm.toxicity import fit_toxicity, score_toxicity
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.1"


def area(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("label,parts,left_out,least", [("quality", 5, 0, 0.98), ("toxic", 3, 1, 0.97)])
def test_held_out_accuracy(spark, label, parts, left_out, least):
    fit, score = (fit_quality, score_quality) if label == "quality" else (fit_toxicity, score_toxicity)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels, fold("doc_id", parts) != left_out)
    held = labels.filter(fold("doc_id", parts) == left_out).select(F.col("doc_id").alias("i"), F.col(label).alias("y"))
    rows = score(docs, model).join(held, F.col("doc_id") == F.col("i")).select("score", "y").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.y for r in rows])
    assert area(s, y) > least
    assert ((s >= (0.3 if label == "quality" else 0.7)) == y).mean() > 0.97


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_awkward_tables(spark, label):
    fit, score = (fit_quality, score_quality) if label == "quality" else (fit_toxicity, score_toxicity)
    texts = ["good words here", "BAD!! BAD!! idiot", "", None, "x" * 60_000, "word " * 20_000] * 4
    docs = documents(spark, texts).withColumns({"y": F.lit(1), "SCORE": F.lit("clash"), "vector": F.lit(2)})
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, None), (None, 1), (6, 1), (7, 0), (999, 1), (6, 0)], f"doc_id long, {label} int")
    out = score(docs.unionByName(docs), fit(docs, labels, F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "y", "vector", "score"]
    rows = out.collect()
    assert len(rows) == 48 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(round(r.score, 9))
    assert all(len(v) == 1 for v in by.values()) and by[""] == by[None]
    for few in (labels.limit(0), labels.filter(f"{label} = 1")):
        assert {0 <= r.score <= 1 for r in score(docs, fit(docs, few, F.lit(True))).collect()} == {True}
    empty = docs.limit(0)
    assert score(empty, fit(empty, labels, F.lit(True))).count() == 0


def test_temperature_calibrates():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 5))
    y = (draw.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = Network(x, y)
    p = net.probabilities(x)
    for low in (0.1, 0.5, 0.8):
        pick = (p >= low) & (p < low + 0.15)
        assert abs(p[pick].mean() - y[pick].mean()) < 0.1
