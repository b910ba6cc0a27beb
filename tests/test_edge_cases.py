"""Edge-case frames (FIXTURES section 5) against each operator's contract."""

import pytest
from pyspark.sql import functions as F

from churnkit.functions.ranks import dense_row_ids, exact_quantiles
from churnkit.functions.scalar import leave_target, parse_iso_date


def test_leave_target_null_safe(spark):
    df = spark.createDataFrame([(" 31/12/1900 ",), ("31/12/1900",), ("05/01/2001",), (None,)], "DTDEM string")
    got = [r[0] for r in df.select(leave_target("DTDEM")).collect()]
    assert got == [0, 0, 1, 1]


def test_birth_date_parsing(spark):
    df = spark.createDataFrame([("0000-00-00",), ("1950-02-30",), (None,), ("1950-01-02",)], "d string")
    got = [r[0] for r in df.select(parse_iso_date("d")).collect()]
    assert got[:3] == [None, None, None] and str(got[3]) == "1950-01-02"


def test_quartiles_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]], "x double")
    q = exact_quantiles(df, "x", {"q25": 0.25, "q50": 0.5}).first()
    assert q["q25"] == pytest.approx(1.75) and q["q50"] == pytest.approx(2.5)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_exact_quantiles_match_numpy(spark, buckets):
    import numpy as np
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.zeros(300), rng.integers(0, 50, 500), rng.normal(size=200)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    q = exact_quantiles(df, "x", probs, n_buckets=buckets).first()
    for k, p in probs.items():
        assert q[k] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)


def test_qcut_collapse(spark):
    from churnkit.operators.recode import qcut_code, qcut_edges
    cases = {"a": [0] * 8 + [5, 9], "b": [0] * 9 + [5], "c": [0] * 10}
    for name, vals in cases.items():
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        e = qcut_edges(df, {"x": "x"})
        codes = [r[0] for r in df.crossJoin(e.withColumnRenamed("x", "e")).select(qcut_code(F.col("x"), F.col("e"))).collect()]
        expected = {"a": [0] * 8 + [1, 1], "b": [0] * 10, "c": [None] * 10}[name]
        assert codes == expected, name


def test_dense_ids_multi_bucket(spark):
    rows = [(s, i) for s in ("table2", "table1") for i in range(500, 0, -3)]
    df = spark.createDataFrame(rows, "source string, k long")
    out = dense_row_ids(df, "k", [("source", ["table1", "table2"])], out_col="ID", n_buckets=7).collect()
    ids = sorted(r["ID"] for r in out)
    assert ids == list(range(1, len(rows) + 1))
    by = {(r["source"], r["k"]): r["ID"] for r in out}
    assert by[("table1", 2)] == 1 and by[("table2", 2)] == len(rows) // 2 + 1


def test_constant_column_correlation_and_z(spark):
    from churnkit.operators.assoc import pearson_pairs, spearman_pairs
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, x double")
    assert pearson_pairs(df, [("c", "x")]).first()["pearson_r"] is None
    assert spearman_pairs(df, [("c", "x")]).first()["spearman_rho"] is None


def test_yates_and_one_by_k(spark):
    from churnkit.operators.assoc import chi2_pairs
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12
    df = spark.createDataFrame(rows, "p string, q string")
    r = chi2_pairs(df, [("p", "q")]).first()
    # Yates-corrected chi-square of [[10, 5], [3, 12]]
    obs = [[10, 5], [3, 12]]
    n = 30
    chi = 0.0
    for i in range(2):
        for j in range(2):
            e = sum(obs[i]) * (obs[0][j] + obs[1][j]) / n
            d = abs(obs[i][j] - e)
            chi += (d - min(0.5, d)) ** 2 / e
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(chi)
    one = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "p string, q string")
    r1 = chi2_pairs(one, [("p", "q")]).first()
    assert r1["cramers_v"] is None and r1["dof"] == 0


def test_kruskal_perfect_separation(spark):
    from churnkit.operators.assoc import kruskal_anova_pairs
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b"), (2.0, "b")], "x double, g string")
    r = kruskal_anova_pairs(df, [("x", "g")]).first()
    assert r["anova_f"] == float("inf")
    same = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (1.0, "b")], "x double, g string")
    r2 = kruskal_anova_pairs(same, [("x", "g")]).first()
    assert r2["kruskal_h"] is None and r2["anova_f"] is None


def test_mcnemar_edges(spark):
    from churnkit.operators.compare import mcnemar
    same = spark.createDataFrame([(1, 1, 1), (0, 0, 0), (1, 0, 0)], "y_true int, pred_a int, pred_b int")
    r = mcnemar(same, ["a", "b"]).first()
    assert r["p_value"] == 1.0 and r["n01"] == 0 and r["n10"] == 0
    rows = [(1, 0, 1)] * 10 + [(1, 1, 1)] * 5
    d = spark.createDataFrame(rows, "y_true int, pred_a int, pred_b int")
    r = mcnemar(d, ["a", "b"]).first()
    assert r["n01"] == 10 and r["n10"] == 0 and r["stat"] == pytest.approx(8.1)


def test_metrics_edges(spark):
    from churnkit.operators.metrics import binary_metrics
    d = spark.createDataFrame([(1, 0, 0.5), (0, 0, 0.5), (1, 0, 0.5)], "y_true int, pred int, proba double")
    m = binary_metrics(d).first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["roc_auc"] == pytest.approx(0.5)


def test_auc_matches_pairwise_definition(spark):
    import numpy as np
    from churnkit.operators.metrics import roc_auc
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 1)
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, proba double")
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert roc_auc(d).first()["roc_auc"] == pytest.approx(exp)


def test_one_hot_many_levels(spark):
    from churnkit.operators.recode import one_hot, one_hot_rows
    df = spark.range(1200).select(F.col("id").alias("ID"), F.col("id").cast("string").alias("c"))
    wide = one_hot(df, "c", "x")
    assert len(wide.columns) == 1201
    assert wide.filter("ID = 1199").select("x_1199", "x_0").first() == (1, 0)
    assert one_hot_rows(df, "c").count() == 1200


def test_rank_buckets_session_setting(spark):
    from churnkit.functions.ranks import BUCKETS_CONF, average_rank_table
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 5, 5, 5]], "x double")
    spark.conf.set(BUCKETS_CONF, "3")
    try:
        got = {r["x"]: r["rank"] for r in average_rank_table(df, "x").collect()}
    finally:
        spark.conf.unset(BUCKETS_CONF)
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0, 5.0: 6.0}


def test_infer_roles_on_member_table(spark):
    from churnkit.operators.schema import infer_roles
    from churnkit.sources.members import members_mixed
    df = members_mixed(spark, "/root/testdata/sf0.001").withColumn("id_fichier", F.col("ID")).withColumn("flag", F.lit(1))
    roles = {r["column"]: r for r in infer_roles(df).collect()}
    assert {c: roles[c]["role"] for c in ("ID", "id_fichier", "flag", "DTADH", "DTNAIS", "MTREV", "CDSITFAM")} == {
        "ID": "identifier", "id_fichier": "identifier", "flag": "binary", "DTADH": "date", "DTNAIS": "date_or_sentinel", "MTREV": "quantitative", "CDSITFAM": "nominal"}
    declared = {r["column"]: r["role"] for r in infer_roles(df, {"MTREV": "ratio"}).collect()}
    assert declared["MTREV"] == "ratio" and declared["DTADH"] == "date"
    assert roles["id_fichier"]["n_distinct"] == df.count()


def test_dependencies_like_all_pairs_of_rows(spark):
    from itertools import combinations

    from churnkit.operators.quality import discover_dependencies
    rows = [(i % 3, None if i % 3 == 2 else (i % 3) * 10, i % 4, (i % 3) * 4 + i % 4, "x", i // 5) for i in range(24)]
    cols = list("abcdef")

    def holds(x, c):
        seen = {}
        return all(seen.setdefault(tuple(r[cols.index(k)] for k in x), r[cols.index(c)]) == r[cols.index(c)] for r in rows)

    single = {((a,), c) for a in cols for c in cols if a != c and holds((a,), c)}
    double = {(x, c) for x in combinations(cols, 2) for c in cols if c not in x and holds(x, c) and not any(((a,), c) in single for a in x)}
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e string, f int")
    found = {(tuple(r["determinant"].split(", ")), r["dependent"]): r["n_levels"] for r in discover_dependencies(df).collect()}
    assert set(found) == single | double and len(double) > 0
    assert all(n == len({tuple(r[cols.index(k)] for k in x) for r in rows}) for (x, _), n in found.items())
    assert len({r["determinant"] for r in discover_dependencies(df.limit(0)).collect()}) == 6


def test_dependencies_are_ruled_out_on_blocks_and_held_on_all_rows(spark, monkeypatch):
    """Columns that blocks contradict are not counted on the whole table; one contradiction in 30,000 rows is still found."""
    from itertools import combinations

    from churnkit.operators import quality

    i = F.col("id")
    df = spark.range(30000).select((i % 97).alias("a"), (i % 97 % 10).alias("b"), F.when(i == 12345, 77).otherwise(i % 97 % 7).alias("c"),
                                   (i * 7919 % 101).alias("d"), F.when(i % 3 > 0, (i % 97 + i * 7919 % 101) % 13).alias("e"))
    whole, counted = [], quality._tuple_counts

    def count(rows, sets):
        if rows is df:
            whole.extend(sets)
        return counted(rows, sets)
    monkeypatch.setattr(quality, "_tuple_counts", count)
    found = {(r["determinant"], r["dependent"], r["n_levels"]) for r in quality.discover_dependencies(df).collect()}
    data = [tuple(r) for r in df.collect()]
    cols = df.columns
    levels = {x: len({tuple(r[k] for k in x) for r in data}) for n in (1, 2, 3) for x in combinations(range(5), n)}

    def holds(x, c):
        return levels[x] == levels[tuple(sorted((*x, c)))]
    singles = {(a, c) for a in range(5) for c in range(5) if a != c and holds((a,), c)}
    want = {(cols[a], cols[c], levels[(a,)]) for a, c in singles}
    want |= {(f"{cols[a]}, {cols[b]}", cols[c], levels[(a, b)]) for a, b in combinations(range(5), 2) for c in range(5)
             if c not in (a, b) and not {(a, b), (b, a), (a, c), (b, c)} & singles and holds((a, b), c)}
    assert found == want and ("a", "b", 97) in found and ("a", "c", 97) not in found
    assert ("a", "b") in whole and ("c", "d") not in whole


@pytest.mark.parametrize("buckets", ["1", "7"])
def test_auc_of_many_fits_reads_its_rows_once(spark, buckets):
    import numpy as np

    from churnkit.functions.ranks import BUCKETS_CONF
    from churnkit.operators.metrics import roc_auc
    draw = np.random.default_rng(6)
    rows = [(f, int(draw.random() < 0.4), None if draw.random() < 0.05 else float(np.round(draw.random(), 1 + f))) for f in range(3) for _ in range(300)] + [(3, 1, 0.5)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    df = spark.createDataFrame(rows, "fit int, y_true int, proba double").repartition(3).mapInPandas(counted, "fit int, y_true int, proba double")
    spark.conf.set(BUCKETS_CONF, buckets)
    try:
        found = {r["fit"]: r["roc_auc"] for r in roc_auc(df, ["fit"]).collect()}
        whole = roc_auc(spark.createDataFrame(rows, "fit int, y_true int, proba double")).collect()
    finally:
        spark.conf.unset(BUCKETS_CONF)

    def plain(of):
        pairs = [(a > b) + (a == b) / 2 for t, a in of if t for u, b in of if not u]
        return sum(pairs) / len(pairs)
    kept = [(f, t, p) for f, t, p in rows if p is not None]
    assert found.pop(3) is None
    assert found == pytest.approx({f: plain([(t, p) for g, t, p in kept if g == f]) for f in range(3)})
    assert len(whole) == 1 and whole[0]["roc_auc"] == pytest.approx(plain([(t, p) for _, t, p in kept]))
    assert read.value == len(rows)
