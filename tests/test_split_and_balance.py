"""Exact split quotas and SMOTE / k-NN invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_split_quotas_golden(spark):
    from churnkit.operators.split import split_quotas
    # class sizes of the published study: 30,880 leavers / 14,474 stayers
    df = spark.range(45354).select(F.col("id").alias("ID"), (F.col("id") < 30880).cast("int").alias("cible_churn"))
    q = {r["cible_churn"]: r for r in split_quotas(df).collect()}
    assert (q[1]["n_test"], q[0]["n_test"]) == (4633, 2171)
    assert (q[1]["n_val"], q[0]["n_val"]) == (4632, 2171)
    assert (q[1]["n_train"], q[0]["n_train"]) == (21615, 10132)


def test_split_disjoint_exhaustive(spark):
    from churnkit.operators.split import stratified_split
    df = spark.range(2000).select(F.col("id").alias("ID"), (F.col("id") % 3 == 0).cast("int").alias("cible_churn"))
    s = stratified_split(df)
    assert s.count() == 2000 and s.select("ID").distinct().count() == 2000
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes["test"] == 300


def _brute_knn(pts, k):
    X = {p[0]: np.array(p[1:]) for p in pts}
    gid = {}
    for i, v in X.items():
        gid.setdefault(tuple(v), []).append(i)
    gmin = {key: min(ids) for key, ids in gid.items()}
    rank = {i: r + 1 for ids in gid.values() for r, i in enumerate(sorted(ids))}
    out = {}
    for i, v in X.items():
        key = lambda j: (float(((X[j] - v) ** 2).sum()), 0 if tuple(X[j]) == tuple(v) else 1, gmin[tuple(X[j])], rank[j])
        out[i] = [round(float(((X[j] - v) ** 2).sum()), 9) for j in sorted([j for j in X if j != i], key=key)[:k]]
    return X, out


def test_knn_exact_against_brute_force(spark):
    from churnkit.operators.balance import minority_neighbours
    rng = np.random.default_rng(0)
    pts = []
    for i in range(200):
        v = [1.0, 2.0, 3.0] if i < 40 else ([5.0, 5.0, 5.0] if i < 43 else list(np.round(rng.normal(size=3), 1)))
        pts.append((i + 1, *map(float, v)))
    df = spark.createDataFrame(pts, "ID long, a double, b double, c double")
    nb = minority_neighbours(df, ["a", "b", "c"], 5, block=8, n_buckets=4).collect()
    X, exp = _brute_knn(pts, 5)
    got = {}
    for r in nb:
        got.setdefault(r["ID"], {})[r["j"]] = r["nbr_id"]
    for i, d in exp.items():
        g = [round(float(((X[got[i][j]] - X[i]) ** 2).sum()), 9) for j in range(5)]
        assert g == d, i


def test_knn_exact_over_many_leaves_and_blocks(spark):
    from churnkit.operators.balance import minority_neighbours
    rng = np.random.default_rng(3)
    pts = [(i + 1, *map(float, np.round(rng.normal(size=3), 1))) for i in range(400)] + [(401, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(pts, "ID long, a double, b double, c double")
    nb = minority_neighbours(df, ["a", "b", "c"], 5, block=8, n_buckets=4, leaf_blocks=4).collect()
    assert not [r for r in nb if 401 in (r["ID"], r["nbr_id"])]      # no finite distance
    X, exp = _brute_knn(pts[:-1], 5)
    got = {}
    for r in nb:
        got.setdefault(r["ID"], {})[r["j"]] = r["nbr_id"]
    for i, d in exp.items():
        assert [round(float(((X[got[i][j]] - X[i]) ** 2).sum()), 9) for j in range(5)] == d, i


def test_work_per_vector_does_not_grow_with_the_leaf(monkeypatch):
    from churnkit.operators import balance

    class Counted(list):
        taken = 0

        def __getitem__(self, i):
            Counted.taken += 1
            return super().__getitem__(i)

    plain = balance.blocks_of
    monkeypatch.setattr(balance, "blocks_of", lambda vectors, rows: Counted(plain(vectors, rows)))
    share = []
    for n in (4_096, 32_768):
        x, Counted.taken = np.random.default_rng(7).uniform(size=(n, 2)), 0
        found = list(balance.nearest(x, x, 5, 64, itself=True))
        assert sum(len(at) for at, _, _ in found) == n
        share.append(Counted.taken * 64 / n)
    assert share[1] < 1.2 * share[0] < 20 * 1.2      # blocks met by a block of 64 vectors


def test_nearest_keeps_ties_in_order_and_far_coordinates():
    from churnkit.operators.balance import nearest
    for shift in (0.0, 1e6, 1e200):
        rng = np.random.default_rng(11)
        x, y = (np.round(rng.normal(size=(m, 4)), 0) + shift for m in (60, 150))
        within = rng.uniform(0, 9, 60)
        for at, j, d in nearest(x, y, 5, 16, within):
            for row, places, there in zip(at, j, d):
                squares = sum((x[row, c] - y[:, c]) ** 2 for c in range(4))
                wanted = sorted((e, i) for i, e in enumerate(squares) if e <= within[row])[:5]
                assert [(e, i) for e, i in zip(there, places) if i < len(y)] == wanted


def test_smote_minority_of_six_and_segments(spark):
    from churnkit.operators.balance import smote
    rows = [(i, float(i), float(i % 2), 0) for i in range(1, 7)] + [(100 + i, float(i), 1.0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "ID long, a double, b double, cible_churn int")
    out = smote(df, ["a", "b"])
    counts = {r["cible_churn"]: r["count"] for r in out.groupBy("cible_churn").count().collect()}
    assert counts == {0: 20, 1: 20}
    syn = out.filter("is_synthetic").collect()
    assert len(syn) == 14
    assert all(1.0 <= r["a"] <= 6.0 and 0.0 <= r["b"] <= 1.0 for r in syn)


def test_smote_balanced_adds_nothing(spark):
    from churnkit.operators.balance import smote
    rows = [(i, float(i), i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "ID long, a double, cible_churn int")
    assert smote(df, ["a"]).filter("is_synthetic").count() == 0


def test_kendall_exact_with_buckets(spark):
    from churnkit.operators.assoc import kendall_pairs
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros(150), rng.integers(0, 20, 250)]).astype(float)
    y = np.concatenate([rng.integers(0, 5, 150), rng.normal(size=250).round(1)]).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = kendall_pairs(df, [("x", "y")], n_buckets=6).first()
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i + 1, len(x)))
    n0 = len(x) * (len(x) - 1) / 2
    _, tx = np.unique(x, return_counts=True)
    _, ty = np.unique(y, return_counts=True)
    n1, n2 = (tx * (tx - 1) / 2).sum(), (ty * (ty - 1) / 2).sum()
    assert r["kendall_s"] == pytest.approx(s)
    assert r["kendall_tau"] == pytest.approx(s / np.sqrt((n0 - n1) * (n0 - n2)))


def _plain_discordance(v):
    """Pairs i < j with v_i > v_j, by merging."""
    if len(v) < 2:
        return 0, v
    (a, left), (b, right) = _plain_discordance(v[:len(v) // 2]), _plain_discordance(v[len(v) // 2:])
    over = int((len(left) - np.searchsorted(left, right, side="right")).sum())
    return a + b + over, np.sort(np.concatenate([left, right]))


@pytest.mark.parametrize("n_buckets", [None, 3])
def test_kendall_of_many_distinct_values(spark, n_buckets):
    from pyspark.sql import functions as F

    from churnkit.operators.assoc import kendall_pairs
    n = 300_000
    i = F.col("id")
    rows = spark.range(n).select((i * 7919 % n).cast("double").alias("x"), (i * 104729 % n + i * 7919 % n / 2).cast("double").alias("y"), F.lit(1.0).alias("z"))
    at = np.arange(n)
    x, y = at * 7919 % n, at * 104729 % n + at * 7919 % n / 2
    order = np.lexsort((y, x))
    assert len(np.unique(x)) == n
    ties = sum(c * (c - 1) // 2 for c in np.unique(y, return_counts=True)[1].tolist())
    discordant = _plain_discordance(y[order])[0]
    found = {r["var2"]: r for r in kendall_pairs(rows, [("x", "y"), ("x", "z")], n_buckets).collect()}
    assert found["y"]["kendall_s"] == n * (n - 1) / 2 - ties - 2 * discordant
    assert found["z"]["kendall_s"] == 0 and found["z"]["kendall_tau"] is None


def test_kendall_edges(spark):
    from churnkit.operators.assoc import kendall_pairs
    odd = spark.createDataFrame([(1.0, None, 1.0), (float("nan"), 2.0, 2.0), (3.0, 1.0, 2.0), (2.0, 4.0, 2.0)], "x double, y double, z double")
    found = {(r["var1"], r["var2"]): (r["n_apparies"], r["kendall_s"]) for r in kendall_pairs(odd, [("x", "y"), ("x", "z"), ("y", "z")]).collect()}
    assert found == {("x", "y"): (2, -1.0), ("x", "z"): (3, 2.0), ("y", "z"): (3, 0.0)}
    empty = kendall_pairs(odd.limit(0), [("x", "y")]).first()
    assert (empty["n_apparies"], empty["kendall_s"], empty["kendall_tau"]) == (0, None, None)
