import numpy as np
import pytest

from churnkit.operators.certificates import INTERCEPT, logistic_certificate, margin_certificate, top_splits, tree_nodes
from churnkit.operators.margins import fit_margins
from churnkit.operators.models import fit_model


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=400), draw.integers(0, 5, 400)
    y = (a + 0.5 * b + draw.normal(size=400) > 1).astype(int)
    return spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(400)], "ID long, cible_churn int, z_a double, cat_b double").cache()


def test_gradients_vanish_at_the_fits_only(spark, rows):
    features = ["cat_b", "z_a"]
    logreg = fit_model("logreg", {"C": 2.0}, rows, features=features)
    found = logistic_certificate(rows, logreg).collect()
    assert [r["feature"] for r in found] == [*features, INTERCEPT] and all(r["stationary"] and r["n_rows"] == 400 for r in found)
    table = rows.toPandas()
    assert [r["observed"] for r in found] == pytest.approx([(table.cible_churn * table.cat_b).sum(), (table.cible_churn * table.z_a).sum(), table.cible_churn.sum()])
    # another penalty or other rows have another optimum
    logreg.params["C"] = 0.01
    assert not all(r["stationary"] for r in logistic_certificate(rows, logreg).collect())
    from pyspark.sql import functions as F
    weights = fit_margins(rows.withColumn("weight", F.lit(1.0)), features, [{"C": 2.0, "balanced": False, "without": -1}])[0].weights
    assert all(r["stationary"] for r in margin_certificate(rows, features, weights, 2.0).collect())
    for j in range(3):
        moved = [w + 1e-3 * (i == j) for i, w in enumerate(weights)]
        assert not all(r["stationary"] for r in margin_certificate(rows, features, moved, 2.0).collect())


def test_certificates_of_odd_rows(spark, rows):
    odd = spark.createDataFrame([(1, None, 1.0, 1.0), (2, 1, None, float("nan"))], rows.schema)
    features, weights = ["cat_b", "z_a"], fit_margins(rows.selectExpr("*", "1.0D AS weight"), ["cat_b", "z_a"], [{"C": 1.0, "balanced": False, "without": -1}])[0].weights
    found = margin_certificate(odd, features, weights, 1.0).collect()
    assert [(r["n_rows"], r["observed"]) for r in found] == [(1, 0.0), (1, 0.0), (1, 1.0)]
    none = margin_certificate(odd.limit(0), features, weights, 1.0).collect()
    assert [(r["n_rows"], r["observed"], r["stationary"]) for r in none] == [(0, None, False)] * 3


def test_node_table_holds_the_rows_of_each_split(rows):
    nodes = tree_nodes(fit_model("tree", {"criterion": "gini", "max_depth": None}, rows, features=["cat_b"])).collect()
    by_id, table = {r["id"]: r for r in nodes}, rows.toPandas()

    def visit(i, own):
        r = by_id[i]
        assert (r["n_rows"], r["n_churn"]) == (len(own), own.cible_churn.sum())
        if r["left"] >= 0:
            low = own[own.cat_b <= r["threshold"]]
            visit(r["left"], low)
            visit(r["right"], own.drop(low.index))
    visit(0, table)

    def gini(d):
        p = d.cible_churn.mean()
        return 2 * p * (1 - p)
    splits = [(table[table.cat_b <= v], table[table.cat_b > v]) for v in range(4)]
    best = max(gini(table) - (len(a) * gini(a) + len(b) * gini(b)) / len(table) for a, b in splits)
    root = top_splits(tree_nodes(fit_model("tree", {"criterion": "gini", "max_depth": None}, rows, features=["cat_b"]))).filter("node = 'root'").first()
    assert root["gain"] == pytest.approx(best) and root["feature"] == "cat_b"


def test_covariances_add_up_matrices_like_the_pairwise_aggregate(spark, monkeypatch):
    import math

    import numpy as np
    from pyspark.sql import functions as F

    from churnkit.operators import reduce
    draw = np.random.default_rng(4)
    names = ["a", "b", "c", "d", "e", "none"]
    rows = [(float(1e6 + x), float(x * y), None if draw.random() < 0.3 else float(y), None if i % 2 else float(i), 7.0 if i else None, None) for i, (x, y) in enumerate(draw.normal(size=(400, 2)))]
    schema = ", ".join(f"{n} double" for n in names)

    def pairwise(df):
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        return dict(zip(pairs, df.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()))
    plain = spark.createDataFrame(rows, schema).repartition(5)
    odd = plain.union(spark.createDataFrame([(1e6, 1.0, float("nan"), 2.0, None, None), (1e6, None, 1.0, float("inf"), 3.0, None)], schema))
    tables = [plain, odd, plain.limit(0), plain.limit(1), spark.createDataFrame([], schema)]
    wanted = [pairwise(t) for t in tables]

    def refused(*_):
        raise AssertionError("an aggregate for every pair of features")
    monkeypatch.setattr(reduce.F, "covar_pop", refused)
    for table, want in zip(tables, wanted):
        found = {(r["feature1"], r["feature2"]): r["covariance"] for r in reduce.covariances(table, names).collect()}
        assert found.keys() == want.keys()
        for k, w in want.items():
            assert (found[k] is None) == (w is None), k
            assert w is None or (math.isnan(w) and math.isnan(found[k])) or found[k] == pytest.approx(w, rel=1e-7, abs=1e-9), k
