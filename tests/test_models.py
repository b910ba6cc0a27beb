"""PCA invariants, naive Bayes against a direct computation, experiment plan sizes."""

import math

import numpy as np
import pytest


def test_pca_orthonormal_and_ratios(spark):
    from churnkit.operators.reduce import fit_pca
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 2))
    X = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.1 * base[:, 1], base[:, 1], rng.normal(size=300)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double, d double")
    res = fit_pca(df, ["a", "b", "c", "d"], 0.95)
    L = np.array(res.loadings)
    assert np.allclose(L @ L.T, np.eye(4), atol=1e-8)
    ev = np.linalg.eigvalsh(np.cov(X.T))[::-1]
    assert np.allclose(res.ratios, ev / ev.sum(), atol=1e-8)
    assert res.k == int(np.searchsorted(np.cumsum(ev / ev.sum()), 0.95 - 1e-12) + 1)
    for row in L:
        assert row[np.argmax(np.abs(row))] > 0


def test_categorical_nb_direct(spark):
    from churnkit.operators.models import fit_categorical_nb
    rows = [(1, 0, 0, 1), (2, 0, 1, 1), (3, 1, 1, 0), (4, 1, 2, 0), (5, 0, 0, 1), (6, 2, 1, 0)]
    df = spark.createDataFrame(rows, "ID long, f1 int, f2 int, cible_churn int")
    m = fit_categorical_nb(df, ["f1", "f2"], alpha=1.0)
    got = {r["ID"]: r["proba"] for r in m.transform(df).collect()}
    y = np.array([r[3] for r in rows])
    F_ = np.array([[r[1], r[2]] for r in rows])
    K = F_.max(axis=0) + 1
    for i, r in enumerate(rows):
        jll = []
        for c in (0, 1):
            sel = y == c
            ll = math.log(sel.sum() / len(y))
            for f in range(2):
                n = ((F_[sel, f]) == F_[i, f]).sum()
                ll += math.log((n + 1.0) / (sel.sum() + 1.0 * K[f]))
            jll.append(ll)
        p1 = 1 / (1 + math.exp(jll[0] - jll[1]))
        assert got[r[0]] == pytest.approx(p1, rel=1e-12)


def test_plan_table(spark):
    from churnkit.plans.experiment import first_points, plan_table
    full = plan_table(spark).orderBy("position", "grid_index").collect()
    assert len(full) == 41 and plan_table(spark, "quick").count() == 5 and first_points(plan_table(spark)).count() == 5
    tree = [r.params for r in full if r.key == "tree"]
    assert tree[0] == '{"max_depth": null, "criterion": "gini", "min_samples_leaf": 1}'
    assert tree[1] == '{"max_depth": null, "criterion": "gini", "min_samples_leaf": 5}'
    assert tree[-1] == '{"max_depth": 10, "criterion": "entropy", "min_samples_leaf": 5}'
    assert len(set(r.params for r in full if r.key == "rf")) == 12


def test_choose(spark):
    from churnkit.plans.experiment import choose
    w = spark.createDataFrame([(0, "tree", "{}", 0.7), (1, "rf", '{"a": null}', 0.7), (2, "svm", "{}", None)], "position int, key string, params string, val_roc_auc double")
    assert choose(w)["key"] == "tree" and choose(w, "rf")["params"] == {"a": None}
    assert choose(w.filter("key = 'svm'"))["key"] == "svm"
    with pytest.raises(ValueError):
        choose(w, "knn")


def test_queries_rest_on_the_whole_grid(spark, monkeypatch):
    from churnkit import catalog
    from churnkit.plans import experiment
    used = []

    class Stop(Exception):
        pass

    def tune(session, train, val, grid="grid"):
        used.append(experiment.plan_table(session, grid).count())
        raise Stop

    monkeypatch.setattr(experiment, "tune", tune)
    monkeypatch.setattr(catalog, "_STAGES", {})
    whole = ["M10_tuning", "M10_best_validation_predictions", "M12_final_test_metrics", "M13_final_confusion", "M16_interpretation",
             "M17_comparison_report", "M18_score_members", "STREAM_scoring"]
    for name in whole + ["M10_tuning_quick"]:
        with pytest.raises(Stop):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert used == [41] * len(whole) + [5]
