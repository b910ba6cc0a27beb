"""Whitening against numpy on all vectors at once; malformed, equal, very common and huge vectors."""

import math

import numpy as np
import pytest

from churnkit.llm import whitening
from churnkit.llm.whitening import whiten_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, weight="one", components=4):
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0) if weight == "one" else x
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, units = np.linalg.eigh(c.T @ c / n)
    values, units = values[::-1], units[:, ::-1]
    good = values[:components] > values.sum() * x.shape[1] * 2.3e-16
    y = (x - s / n) @ units[:, :components] / np.sqrt(np.where(good, values[:components], 1))
    return n, ((n * x.astype(object) - s) ** 2).sum(axis=1), np.where(good, y, np.nan), values[:components] / values.sum()


def compare(rows, vectors, ids, **options):
    n, deviation, y, explained = plain(vectors, **options)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    got = np.array([[np.nan if w.whitened is None else w.whitened for w in by_id[i][0].whitened] for i in ids], dtype=float)
    for k in range(y.shape[1]):
        sign = min(np.nanmax(np.abs(got[:, k] - y[:, k]), initial=0), np.nanmax(np.abs(got[:, k] + y[:, k]), initial=0))
        assert sign < 1e-8 and (np.isnan(got[:, k]) == np.isnan(y[:, k])).all()
    for i, d in zip(ids, deviation):
        assert by_id[i][0].n == n and by_id[i][0].deviation == d
        assert np.allclose([w.explained for w in by_id[i][0].whitened], explained, rtol=1e-6, atol=1e-12)
        assert all(w.identity_error < 1e-8 for w in by_id[i][0].whitened)


@pytest.mark.parametrize("weight", ["one", "count"])
def test_like_numpy_with_copies_and_malformed_rows(spark, weight):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, 7)).astype(np.float32)
    vectors[100:200] = vectors[5]                     # a third of all rows is one vector
    vectors[200:230] = vectors[:30] + np.float32(1e-4)  # some fall on the same whole numbers
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    bad = [(1000, None, 1), (1001, [1.0, None] + [0.0] * 5, 1), (1002, [math.nan] * 7, 1), (1003, [math.inf] + [0.0] * 6, 1), (1004, [], 1), (1005, [1.0], 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumnRenamed("label", "N")
    out = whiten_vectors(df, weight=weight)
    assert sorted(out.columns) == ["deviation", "embedding", "n", "vec_id", "whitened"]
    found = out.collect()
    assert sorted(r.vec_id for r in found) == list(range(300))
    compare(found, vectors, range(300), weight=weight)


def test_common_vectors_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COMMON", 4)
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(60, 5)).astype(np.float32)
    vectors[:40] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], SCHEMA)
    compare(whiten_vectors(df).collect(), vectors, range(60))


def test_few_dimensions_constant_and_empty(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (None, [-0.0, 0.25], 0)], SCHEMA)
    rows = whiten_vectors(one).collect()
    assert len(rows) == 3 and all(len(r.whitened) == 2 and r.n == 2 for r in rows)
    assert sorted(round(abs(r.whitened[0].whitened), 9) for r in rows) == [1, 1, 1] and all(r.whitened[1].whitened is None for r in rows)
    same = spark.createDataFrame([(1, [0.5], 0), (2, [0.5], 0)], SCHEMA)
    rows = whiten_vectors(same).collect()
    assert [(r.n, r.deviation, r.whitened[0].whitened, r.whitened[0].explained, r.whitened[0].identity_error) for r in rows] == [(1, 0, None, None, None)] * 2
    assert whiten_vectors(same.limit(0)).count() == 0
    assert whiten_vectors(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_exact_beyond_64_bits(spark):
    big = [(i, [float(i * 2**30), 1.0, 0.0], 0) for i in range(5)]
    rows = whiten_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")).collect()
    x = [[i * 2**38, 256, 0] for i in range(5)]
    for r in rows:
        exact = sum((5 * a - sum(v[d] for v in x)) ** 2 for d, a in enumerate(x[r.vec_id]))
        assert r.deviation == (exact if exact < 2**63 else None)
    negative = [(i, [-float(i) - 0.001 * i, 300.0 * i], 0) for i in range(9)]
    compare(whiten_vectors(spark.createDataFrame(negative, SCHEMA)).collect(), [v for _, v, _ in negative], range(9))


def test_query_over_the_whole_table(spark):
    from churnkit.llm.queries import QUERIES, read

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    table = read(spark, sf, "embeddings").collect()
    n, deviation, y, explained = plain([r.embedding for r in table])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == 4 * len(table)
    for k in range(4):
        column = np.array([got[r.vec_id, k + 1].whitened for r in table])
        assert min(np.abs(column - y[:, k]).max(), np.abs(column + y[:, k]).max()) < 1e-8
    assert all(r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-6 and r.identity_error < 1e-8 for r in rows)
    assert [got[r.vec_id, 1].deviation for r in table] == deviation.tolist()
