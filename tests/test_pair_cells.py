"""The common cells of all pairs: every family gives what it gives from cells of its own."""

import math

import pytest

from churnkit.operators.assoc import (bivariate_summary, chi2_pairs, kendall_pairs, kruskal_anova_pairs, pair_cells, pair_plan,
                                      pearson_of_cells, pearson_pairs, spearman_pairs)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 7) if i % 11 else None, (i * i) % 13, 5, "abc"[i % 3], "xy"[i % 2] if i % 5 else None,
             math.nan if i % 17 == 0 else i / 3) for i in range(120)]
    return spark.createDataFrame(data, "ID long, a double, b int, same int, p string, q string, r double")


def _same(one, two):
    one, two = ({(r["var1"], r["var2"]): r.asDict() for r in df.collect()} for df in (one, two))
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert r == pytest.approx(two[k], nan_ok=True, abs=1e-12), k


def test_families_from_common_cells(rows):
    plan = pair_plan(rows)
    cells = pair_cells(rows, plan)
    _same(pearson_of_cells(cells, plan["quant"]), pearson_pairs(rows, plan["quant"]))
    _same(spearman_pairs(rows, plan["quant"], cells), spearman_pairs(rows, plan["quant"]))
    _same(kendall_pairs(rows, plan["quant"], cells=cells), kendall_pairs(rows, plan["quant"]))
    _same(chi2_pairs(rows, plan["qual"], cells), chi2_pairs(rows, plan["qual"]))
    _same(kruskal_anova_pairs(rows, plan["mixed"], cells), kruskal_anova_pairs(rows, plan["mixed"]))


def test_cells_count_complete_rows(rows):
    got = {(r["var1"], r["var2"]): r["n"] for r in pair_cells(rows, pair_plan(rows)).groupBy("var1", "var2").agg({"w": "sum"})
           .withColumnRenamed("sum(w)", "n").collect()}
    assert len(got) == 15
    data = [r.asDict() for r in rows.collect()]

    def there(v):
        return v is not None and v == v
    for (a, b), n in got.items():
        assert n == sum(there(r[a]) and there(r[b]) for r in data)


def test_constant_column_and_empty_table(rows):
    plan = pair_plan(rows)
    of = {(r["var1"], r["var2"]): r["pearson_r"] for r in pearson_of_cells(pair_cells(rows, plan), plan["quant"]).collect()}
    assert of["a", "same"] is None and of["b", "same"] is None and of["a", "b"] is not None
    empty = bivariate_summary(rows.limit(0)).collect()
    assert len(empty) == 15 and all(r["n_apparies"] == 0 and r["pearson_r"] is None and r["chi2"] is None for r in empty)


def test_rows_of_cells_are_generated_code(rows):
    from churnkit.operators.assoc import _cell_rows
    plan = _cell_rows(rows, pair_plan(rows))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Generate" in plan


def test_buckets_isolate_split_values(spark):
    from churnkit.operators.assoc import _isolating_bucket
    splits = [1.0, 1.0, 2.0, 4.0, 4.0, 4.0, 7.0]
    values = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 8.0]
    df = spark.createDataFrame([(v, splits) for v in values], "x double, s array<double>").select("x", _isolating_bucket("x", "s", 9).alias("b"))
    for r in df.collect():
        assert r["b"] == 2 * sum(s < r["x"] for s in splits) + (r["x"] in splits)
