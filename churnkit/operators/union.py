"""Stacking the two member tables (U1-U4) and the union summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.functions.ranks import dense_row_ids
from churnkit.functions.scalar import leave_target
from churnkit.operators.schema import common_columns, solo_columns

SOURCES = ["table1", "table2"]   # fixed labels of the two origins, table1 first


def _tag(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source)).withColumn("id_fichier", F.col("ID").cast("long"))


def _renumber(u: DataFrame, n_buckets: int) -> DataFrame:
    """Fresh dense ``ID`` 1..n: table1 rows first, each source in original-id order."""
    keyed = u.withColumn("_content", F.xxhash64(*u.columns))   # rows that share an id keep a reproducible order
    return dense_row_ids(keyed, "id_fichier", [("source", SOURCES)], out_col="ID", n_buckets=n_buckets, tie_cols=["_content"]).drop("_content")


def union_common(t1: DataFrame, t2: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """UNION ALL on the common columns + ``source``; original id kept as ``id_fichier``."""
    cols = common_columns(t1, t2)
    u = _tag(t1.select(*cols), SOURCES[0]).unionByName(_tag(t2.select(*cols), SOURCES[1]))
    return _renumber(u, n_buckets).select(*cols, "source", "id_fichier")


def union_labelled(t1: DataFrame, t2: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """U1 + observed label (every table1 row left; table2 by the leave-date sentinel)."""
    u = union_common(t1, t2, n_buckets)
    return u.withColumn("label_churn_obs",
                        F.when(F.col("source") == SOURCES[1], leave_target("DTDEM")).otherwise(F.lit(1)))


def union_full(t1: DataFrame, t2: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """UNION ALL on all columns (absent -> NULL), ``source``, ``id_fichier``, ``cible_churn``."""
    a = _tag(t1, SOURCES[0]).withColumn("cible_churn", F.lit(1))
    b = _tag(t2, SOURCES[1]).withColumn("cible_churn", leave_target("DTDEM"))
    u = a.unionByName(b, allowMissingColumns=True)
    cols = list(t1.columns) + ["source", "id_fichier", "cible_churn"] + [c for c in t2.columns if c not in t1.columns]
    return _renumber(u, n_buckets).select(*cols)


def train_and_validation(split_df: DataFrame) -> DataFrame:
    """U4: training and validation rows together (refit before the final test)."""
    return split_df.filter(F.col("split").isin("train", "val"))


def union_summary(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """One-row summary of the three label views, in a single scan of both tables.

    The union views need no materialisation: their row counts and label counts follow from
    per-table conditional counts (the common-column union and the full union hold the same
    rows with the same label).
    """
    common = common_columns(t1, t2)
    only1, only2 = solo_columns(t1, t2)
    y2 = leave_target("DTDEM")
    s1 = t1.agg(F.count("*").alias("n1"))
    s2 = t2.agg(F.count("*").alias("n2"), F.sum(y2).cast("long").alias("leave2"))
    s = s1.crossJoin(s2)   # two single-row aggregates
    n_full_cols = len(set(t1.columns) | set(t2.columns)) + 3
    return s.select(
        F.col("n1").alias("n_table1"),
        F.col("n2").alias("n_table2"),
        (F.col("n1") + F.col("n2")).alias("n_union_common"),
        (F.col("n1") + F.col("n2")).alias("n_union_full"),
        F.lit(",".join(common)).alias("common_columns"),
        F.lit(len(common)).alias("n_common_columns"),
        F.lit(",".join(only1)).alias("columns_only_table1"),
        F.lit(",".join(only2)).alias("columns_only_table2"),
        F.lit(n_full_cols).alias("n_columns_union_full"),
        F.round(F.try_divide(F.col("leave2"), F.col("n2").cast("double")), 6).alias("table2_leave_rate"),
        F.col("leave2").alias("table2_n_leave"),
        (F.col("n2") - F.col("leave2")).alias("table2_n_stay"),
        (F.col("n1") + F.col("leave2")).alias("union_common_n_label_1"),
        (F.col("n2") - F.col("leave2")).alias("union_common_n_label_0"),
        (F.col("n1") + F.col("leave2")).alias("union_full_n_churn_1"),
        (F.col("n2") - F.col("leave2")).alias("union_full_n_churn_0"),
        F.round(F.try_divide((F.col("n1") + F.col("leave2")).cast("double"), F.col("n1") + F.col("n2")), 6)
        .alias("union_full_churn_rate"),
    )
