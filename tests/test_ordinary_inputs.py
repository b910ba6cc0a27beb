"""Ordinary inputs the stand-in tables do not hold: column order, quoting, blanks, NaN, unseen codes, one
class, unpadded dates, missing targets and keys, hot ties."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

MEMBERS = "ID int, MTREV int, T string"


def _csv(text):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    with open(os.path.join(d, "t.csv"), "w", encoding="utf-8") as f:
        f.write(text)
    return d


def _read(spark, text, schema=MEMBERS):
    from pyspark.sql.types import StructType

    from churnkit.sources.io import read_members_csv
    return [tuple(r) for r in read_members_csv(spark, _csv(text), StructType.fromDDL(schema)).orderBy("ID").collect()]


def test_csv_columns_by_name(spark):
    assert _read(spark, "MTREV,ID,T\n10,1,a\n20,2,b\n") == [(1, 10, "a"), (2, 20, "b")]
    with pytest.raises(ValueError, match="MTREV"):
        _read(spark, "ID,T\n1,a\n")


def test_csv_quotes_and_blanks(spark):
    rows = _read(spark, 'ID,MTREV,T\n1, 7 ,"a ""q"", z"\n2,NA,"two\nlines"\n3,,   \n4,5, NA \n5,6,NA\n')
    assert rows == [(1, 7, 'a "q", z'), (2, None, "two\nlines"), (3, None, "   "), (4, 5, " NA "), (5, 6, None)]


def test_nan_is_missing(spark):
    from churnkit.operators.assoc import pearson_pairs, spearman_pairs
    from churnkit.operators.profile import quantitative_profile
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (3.0, 2.0), (float("nan"), 9.0)], "a double, b double")
    p = pearson_pairs(df, [("a", "b")]).first()
    assert p["n_apparies"] == 3 and p["pearson_r"] == pytest.approx(-0.5)
    assert spearman_pairs(df, [("a", "b")]).first()["n_apparies"] == 3
    row = quantitative_profile(df, ["a"]).first()
    assert (row["n_non_null"], row["mean"], row["median"]) == (3, 2.0, 2.0)


def test_unseen_category_is_not_category_zero(spark):
    from churnkit.operators.models import fit_categorical_nb
    train = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 1), (4, 1, 0), (5, 1, 0), (6, 0, 0)], "ID long, f int, cible_churn int")
    new = spark.createDataFrame([(1, None), (2, 99), (3, 0)], "ID long, f int")
    got = {r["ID"]: r["proba"] for r in fit_categorical_nb(train, ["f"]).transform(new).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] != pytest.approx(got[3])


def test_anova_one_class(spark):
    from churnkit.operators.reduce import anova_f_scores
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "cible_churn int, x double")
    assert anova_f_scores(df, ["x"]).first()["f_score"] is None


def test_unpadded_dates(spark):
    from churnkit.functions.scalar import parse_dmy_date
    df = spark.createDataFrame([("5/1/2001",), ("05/01/2001",), ("31/2/2001",)], "d string")
    assert [str(r[0]) for r in df.select(parse_dmy_date("d")).collect()] == ["2001-01-05", "2001-01-05", "None"]


def test_split_keeps_rows_without_target(spark):
    from churnkit.operators.split import stratified_split
    df = spark.range(100).select(F.col("id").alias("ID"), F.when(F.col("id") >= 10, (F.col("id") % 2).cast("int")).alias("cible_churn"))
    out = stratified_split(df)
    assert out.count() == 100 and out.filter("cible_churn is null").count() == 10
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 15, "val": 16, "train": 69}


@pytest.mark.parametrize("buckets", [None, 5])
def test_ids_of_all_null_groups(spark, buckets):
    from churnkit.functions.ranks import dense_row_ids
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2), ("b", 1), (None, 3)], "g string, k long")
    out = dense_row_ids(df, "k", [("g", ["a", "b"])], n_buckets=buckets)
    assert sorted(r["ID"] for r in out.collect()) == [1, 2, 3, 4, 5]
    within = dense_row_ids(df, "k", out_col="n", group_cols=["g"], n_buckets=buckets).collect()
    assert sorted((r["g"] or "", r["k"] or 0, r["n"]) for r in within if r["g"] == "b") == [("b", 1, 1), ("b", 2, 2)]
    assert len(within) == 5


def test_hot_tie_is_cut_by_the_tie_column(spark):
    from churnkit.functions.ranks import _attach_buckets, dense_row_ids
    df = spark.range(5000).select(F.col("id").alias("ID"), F.when(F.col("id") < 4000, 0.5).otherwise(F.rand(1)).alias("s"))
    out = dense_row_ids(df, "s", out_col="n", tie_cols=["ID"], n_buckets=16)
    rows = sorted((r["s"], r["ID"], r["n"]) for r in out.collect())
    assert [r[2] for r in rows] == list(range(1, 5001))
    b = _attach_buckets(df, "s", [], 16).withColumn("_tie", F.when(F.col("_b") % 2 == 1, F.col("ID").cast("double")))
    assert b.filter("s = 0.5").select("_b").distinct().count() == 1
    assert _attach_buckets(b, "_tie", ["_b"], 16, out="_b2").filter("s = 0.5").select("_b2").distinct().count() > 10


def test_session_leaves_master_to_the_cluster():
    import inspect

    from churnkit import session
    assert inspect.signature(session.get_spark).parameters["master"].default is None


def test_ordered_windows_are_dealt_to_many_tasks(spark):
    """Two groups, many buckets: no join brings a group's rows into one partition, ids stay exact."""
    from churnkit.functions.ranks import _attach_buckets, _below, dense_row_ids

    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k"), (F.col("id") % 2).alias("g"), F.lit("x").alias("t"))
    plan = _attach_buckets(df, "k", ["g"], 40)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    out = dense_row_ids(df, "k", [("g", [1, 0])], out_col="ID", n_buckets=40, tie_cols=["t"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000
    want = sorted((-r["g"], r["k"]) for r in df.collect())
    assert [(-r["g"], r["k"]) for r in out.orderBy("ID").collect()] == want
    for n in (1, 2, 7, 63, 64, 1000):
        values = F.array(*[F.lit(float(2 * i)) for i in range(n)])
        found = spark.range(-3, 2 * n + 3).select("id", values.alias("a")).select("id", _below("a", n, F.col("id").cast("double")).alias("b")).collect()
        assert [r["b"] for r in found] == [min(n, max(0, -(-r["id"] // 2))) for r in found]
