"""Exact stratified train / validation / test split (F17) and partition statistics.

Sizes follow the stratified shuffle split of scikit-learn: ``n_test = ceil(test_size * n)``;
the training part is allocated to classes first by largest remainder (integer arithmetic,
ties to the smaller class value), the test part takes the rest of each class; the
validation cut repeats this on train+validation. Row membership is decided by a seeded
md5 order within each class (identical in any engine), with positions computed in
parallel buckets, so no class is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.ranks import dense_row_ids

TEST_SIZE = 0.15
VAL_SIZE_IN_REST = 0.15 / (1 - 0.15)
SEED = 42


def md5_order_key(id_col: str = "ID", seed: int = SEED) -> Column:
    """60-bit integer from the md5 of ``'<id>|<seed>'`` (first 15 hex digits)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _largest_remainder(counts: DataFrame, count_col: str, draws: Column, out_col: str, class_col: str) -> DataFrame:
    """Allocate ``draws`` items to classes proportionally to ``count_col``: floors, then one
    more to the largest remainders (exact integer arithmetic; ties -> smaller class value).
    ``counts`` has one row per class, so the whole-table windows below see a handful of rows."""
    tot = F.sum(count_col).over(Window.partitionBy())
    c = counts.withColumn("_tot", tot).withColumn("_m", draws)
    num = F.col(count_col) * F.col("_m")
    c = c.withColumn("_fl", F.floor(num / F.col("_tot")).cast("long")).withColumn("_rem", num % F.col("_tot"))
    c = c.withColumn("_need", F.col("_m") - F.sum("_fl").over(Window.partitionBy()))
    c = c.withColumn("_rk", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(class_col).asc())))
    return c.withColumn(out_col, F.col("_fl") + (F.col("_rk") <= F.col("_need")).cast("long")).drop(
        "_tot", "_m", "_fl", "_rem", "_need", "_rk")


def split_quotas(df: DataFrame, target: str = "cible_churn", test_size: float = TEST_SIZE,
                 val_size: float = VAL_SIZE_IN_REST) -> DataFrame:
    """Per class: ``n_class, n_test, n_val, n_train`` (one row per class; classes are few)."""
    counts = df.groupBy(target).agg(F.count("*").alias("n_class"))
    n = F.sum("n_class").over(Window.partitionBy())
    q = counts.withColumn("_n_trval", n - F.ceil(F.lit(test_size) * n))
    q = _largest_remainder(q, "n_class", F.col("_n_trval"), "n_trval", target)
    n2 = F.sum("n_trval").over(Window.partitionBy())
    q = q.withColumn("_n_tr", n2 - F.ceil(F.lit(val_size) * n2))
    q = _largest_remainder(q, "n_trval", F.col("_n_tr"), "n_train", target)
    return q.select(target, "n_class", (F.col("n_class") - F.col("n_trval")).alias("n_test"),
                    (F.col("n_trval") - F.col("n_train")).alias("n_val"), "n_train")


def stratified_split(df: DataFrame, target: str = "cible_churn", id_col: str = "ID", seed: int = SEED,
                     test_size: float = TEST_SIZE, val_size: float = VAL_SIZE_IN_REST) -> DataFrame:
    """adds ``split`` in {'train', 'val', 'test'} with exact per-class sizes.

    Rows without a target are a class of their own: none is lost.
    """
    quotas = split_quotas(df, target, test_size, val_size)   # one row per class
    keyed = df.withColumn("_h", md5_order_key(id_col, seed))
    pos = dense_row_ids(keyed, "_h", out_col="_pos", group_cols=[target], tie_cols=[id_col])
    small = F.broadcast(quotas.select(F.col(target).alias("_class"), "n_test", "n_val"))
    j = pos.join(small, pos[target].eqNullSafe(small["_class"])).drop("_class")
    split = (F.when(F.col("_pos") <= F.col("n_test"), F.lit("test"))
             .when(F.col("_pos") <= F.col("n_test") + F.col("n_val"), F.lit("val")).otherwise(F.lit("train")))
    return j.withColumn("split", split).drop("_h", "_pos", "n_test", "n_val")


def partition_stats(split_df: DataFrame, target: str = "cible_churn") -> DataFrame:
    """Per part: n, share of all rows (2 dp), class counts, class-1 rate (6 dp)."""
    g = split_df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("n_churn_1"),
                                      F.count_if(F.col(target) == 0).alias("n_churn_0"),
                                      F.avg(F.col(target).cast("double")).alias("_rate"))
    total = F.sum("n").over(Window.partitionBy())   # three rows
    return g.select(F.col("split").alias("nom"), "n", F.round(100.0 * F.col("n") / total, 2).alias("pct_total"),
                    "n_churn_1", "n_churn_0", F.round("_rate", 6).alias("taux_churn"))

