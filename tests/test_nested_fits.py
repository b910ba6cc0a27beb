"""Shared fits: cut trees equal separate ones, squared-hinge optimality, calibration, stored fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators.margins import calibrate, fit_margins
from churnkit.operators.models import fit_categorical_nb, fit_model, nb_counts, score_depths


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(700, 4)), 2)
    y = (x[:, 0] - 0.7 * x[:, 1] + draw.normal(size=700) > 0.3).astype(int)
    data = [(i, int(t), *map(float, r), int(i % 5), int(abs(r[2]) * 2)) for i, (t, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, "ID long, cible_churn int, z_a double, z_b double, z_c double, sit_d double, cat_p int, cat_q int").coalesce(2).cache()


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("least", [1, 5])
def test_cut_trees_equal_separate_fits(spark, rows, tmp_path, criterion, least):
    depths = [None, 1, 2, 5, 10]
    base = {"criterion": criterion, "min_samples_leaf": least}
    deep = fit_model("tree", base | {"max_depth": None}, rows)
    got = score_depths(deep, rows, depths, f"{tmp_path}/nodes").collect()
    assert len(got) == 700 * len(depths)
    for i, d in enumerate(depths):
        alone = {r["ID"]: (r["pred"], r["proba"]) for r in fit_model("tree", base | {"max_depth": d}, rows).transform(rows).collect()}
        assert {r["ID"]: (r["pred"], r["proba"]) for r in got if r["depth_index"] == i} == alone


def test_growing_trees_are_not_shipped(rows):
    from pyspark.ml.classification import DecisionTreeClassifier

    from churnkit.operators.models import _depth, assembled, build_estimator
    assert build_estimator("tree", {}).getCacheNodeIds()
    plain = DecisionTreeClassifier(labelCol="cible_churn", seed=42, maxDepth=_depth(None), maxBins=64).fit(assembled(rows, ["z_a", "z_b"]))
    assert fit_model("tree", {}, rows, features=["z_a", "z_b"]).model.stages[-1].toDebugString.partition("\n")[2] == plain.toDebugString.partition("\n")[2]


def test_one_count_serves_all_smoothings(rows):
    counts = nb_counts(rows, ["cat_p", "cat_q"])
    for alpha in (0.1, 1.0):
        shared = fit_categorical_nb(rows, ["cat_p", "cat_q"], alpha, counts=counts).transform(rows)
        assert shared.exceptAll(fit_categorical_nb(rows, ["cat_p", "cat_q"], alpha).transform(rows)).count() == 0


FEATURES = ["z_a", "z_b", "z_c", "sit_d"]


def plain_loss(v, x, y, s, c):
    short = np.maximum(0, 1 - y * (x @ v))
    return v @ v / 2 + c * (s * short ** 2).sum(), v - 2 * c * (s * y * short) @ x


def test_squared_hinge_is_optimal(rows):
    d = rows.withColumn("weight", F.when(F.col("cible_churn") == 1, 1.4).otherwise(0.8)).withColumn("fold", F.col("ID") % 3)
    models = [{"C": c, "balanced": b, "without": w} for c in (0.01, 1.0, 10.0) for b in (False, True) for w in (-1, 0, 2)]
    fitted = fit_margins(d, FEATURES, models, fold="fold")
    table = d.orderBy("ID").toPandas()
    for m, f in zip(models, fitted):
        own = table[table.fold != m["without"]]
        x = np.c_[own[FEATURES].to_numpy(), np.ones(len(own))]
        y, s = 2.0 * own.cible_churn.to_numpy() - 1, own.weight.to_numpy() if m["balanced"] else np.ones(len(own))
        v = np.array(f.weights)
        loss, gradient = plain_loss(v, x, y, s, m["C"])
        assert np.abs(gradient).max() < 1e-6 * (1 + m["C"]) and np.abs(np.abs(gradient).max() - f.gradient) < 1e-6
        draw = np.random.default_rng(1)
        assert all(plain_loss(v + draw.normal(size=5) * e, x, y, s, m["C"])[0] > loss for e in (1e-3, 1e-1) for _ in range(20))


def test_calibration_is_the_logistic_optimum(rows):
    d = rows.withColumn("weight", F.lit(1.0)).withColumn("fold", F.col("ID") % 3)
    models = [{"C": 1.0, "balanced": False, "without": k} for k in range(3)]
    fitted = fit_margins(d, FEATURES, models, fold="fold")
    calibrate(d, FEATURES, fitted, [0, 1, 2])
    table = d.toPandas()
    for k, m in enumerate(fitted):
        own = table[table.fold == k]
        margin = np.c_[own[FEATURES].to_numpy(), np.ones(len(own))] @ np.array(m.weights)
        n1, n0 = own.cible_churn.sum(), (1 - own.cible_churn).sum()
        t = np.where(own.cible_churn == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        e = t - 1 / (1 + np.exp(m.slope * margin + m.offset))
        assert abs(e.sum()) < 1e-5 and abs((e * margin).sum()) < 1e-5 and m.slope < 0


def test_a_step_adds_up_matrices_not_columns(spark, monkeypatch):
    from churnkit.operators import margins
    draw = np.random.default_rng(9)
    x, y, weight, fold = draw.normal(size=(500, 40)), np.where(draw.random(500) < 0.4, 1.0, -1.0), draw.random(500), draw.integers(0, 3, 500)
    d = spark.createDataFrame([(int(f), float(t), float(w), *map(float, r)) for f, t, w, r in zip(fold, y, weight, x)],
                              "fold int, y double, weight double, " + ", ".join(f"x{j} double" for j in range(40))).repartition(4)
    models = [{"C": 1.0, "balanced": b, "without": w} for b in (False, True) for w in (-1, 1)]
    at = draw.normal(size=(4, 40)) / 10

    def refused(*_):
        raise AssertionError("a sum for every pair of features")
    monkeypatch.setattr(margins.F, "sum", refused)
    found = margins._sums(d, 40, models, at, 3)
    for i, m in enumerate(models):
        own = fold != m["without"]
        s = weight[own] if m["balanced"] else np.ones(own.sum())
        short = np.maximum(0, 1 - y[own] * (x[own] @ at[i]))
        assert found[i][0] == pytest.approx((s * short ** 2).sum()) and np.allclose(found[i][1], (s * short * y[own]) @ x[own])
        assert np.allclose(found[i][2], (x[own] * (s * (short > 0))[:, None]).T @ x[own])
    assert margins._sums(d.filter("fold = 1"), 40, models, at, 3).keys() == {0, 2}


def test_margins_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 1, float("nan")), (3, None, 5.0), (4, 1, 2.0)], "ID long, cible_churn int, z_a double").withColumn("weight", F.lit(None).cast("double"))
    one = fit_margins(rows, ["z_a"], [{"C": 1.0, "balanced": True, "without": -1}])[0]
    x, y = np.array([[0, 1], [0, 1], [2, 1]]), np.array([-1, 1, 1])
    assert np.abs(plain_loss(np.array(one.weights), x, y, np.ones(3), 1.0)[1]).max() < 1e-6
    assert fit_margins(rows.limit(0), ["z_a"], [{"C": 1.0, "balanced": False, "without": -1}])[0].weights == [0.0, 0.0]


def test_stopped_tuning_goes_on(spark, rows, monkeypatch):
    import uuid

    from churnkit.plans import experiment
    monkeypatch.setattr(experiment, "VERSION", uuid.uuid4().hex)
    points = [("tree", "z", {"max_depth": d, "criterion": "gini", "min_samples_leaf": 1}) for d in (None, 3)]
    points += [("rf", "z", {"n_estimators": 3, "max_depth": 3, "max_features": "sqrt", "class_weight": "balanced"}), ("cnb", "cat", {"alpha": 1.0}),
               ("logreg", "z", {"C": 1.0, "class_weight": None}), ("svm", "z", {"C": 1.0, "class_weight": "balanced"})]
    import json
    plan = spark.createDataFrame([(0, k, k, m, i, json.dumps(p)) for i, (k, m, p) in enumerate(points)], "position int, key string, label string, mode string, grid_index int, params string")
    train, val = rows.filter("ID % 4 > 0"), rows.filter("ID % 4 = 0")
    first = experiment.fit_plan(spark, plan, train, val)
    assert {(r["key"], r["n"]) for r in first.groupBy("key", "grid_index").agg(F.count("*").alias("n")).collect()} == {(k, 175) for k, _, _ in points}
    alone = {r["ID"]: r["proba"] for r in fit_model("tree", points[1][2], train).transform(val).collect()}
    assert {r["ID"]: r["proba"] for r in first.filter("key = 'tree' and grid_index = 1").collect()} == pytest.approx(alone)
    monkeypatch.setattr(experiment, "fit_model", None)      # nothing is fitted again
    monkeypatch.setattr(experiment, "fit_svms", None)
    assert experiment.fit_plan(spark, plan, train, val).exceptAll(first).count() == 0
    assert experiment.fit_store(spark, train, val) != experiment.fit_store(spark, train, val.filter("ID > 0"))


def test_fits_share_balanced_weights_and_are_read_in_one_scan(spark, rows, monkeypatch):
    import json
    import uuid

    from churnkit.operators import models
    from churnkit.plans import experiment
    monkeypatch.setattr(experiment, "VERSION", uuid.uuid4().hex)
    points = [("cnb", "cat", {"alpha": 0.5}), ("cnb", "cat", {"alpha": 1.0})] + [("logreg", "z", {"C": c, "class_weight": "balanced"}) for c in (0.1, 1.0)]
    plan = spark.createDataFrame([(0, k, k, m, i, json.dumps(p)) for i, (k, m, p) in enumerate(points)], "position int, key string, label string, mode string, grid_index int, params string")
    train, val = rows.filter("ID % 4 > 0"), rows.filter("ID % 4 = 0")
    alone = {r["ID"]: r["proba"] for r in fit_model("logreg", points[2][2], train).transform(val).collect()}
    counted = []
    plain = models.with_balanced_weights
    monkeypatch.setattr(models, "with_balanced_weights", lambda *a, **b: counted.append(1) or plain(*a, **b))
    found = experiment.fit_plan(spark, plan, train, val)
    assert not counted                                       # once for all, with the assembled rows
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert found.count() == 175 * len(points)
    assert {r["ID"]: r["proba"] for r in found.filter("key = 'logreg' and grid_index = 2").collect()} == pytest.approx(alone)
    assert experiment.fit_plan(spark, plan.limit(0), train, val).count() == 0


def test_rows_without_a_class_keep_their_place(spark):
    from churnkit.operators.models import with_balanced_weights
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "ID long, cible_churn int")
    kept = {r["ID"]: r["weight"] for r in with_balanced_weights(df, how="left").collect()}
    assert set(kept) == {1, 2, 3, 4} and kept[4] is None
    assert {r["ID"]: r["weight"] for r in with_balanced_weights(df).collect()} == {i: kept[i] for i in (1, 2, 3)}


def test_node_table_is_read_as_columns(rows, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    deep = fit_model("tree", {"max_depth": None}, rows)
    monkeypatch.setattr(DataFrame, "collect", None)          # no row objects of a deep tree on the driver
    scored = score_depths(deep, rows, [None, 2], f"{tmp_path}/nodes")
    assert scored.columns == ["ID", "depth_index", "pred", "proba"] and scored.count() == 1400
