"""Classification metrics on prediction tables.

A prediction table has one row per scored member: ``y_true`` (0/1), ``pred`` (0/1),
``proba`` (score of class 1) and optional grouping columns (e.g. ``algo``). Everything is
one grouped aggregation; the exact ROC AUC uses the distributed average ranks of the
distinct scores (Mann-Whitney form), not a binned curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.ranks import rank_sums
from churnkit.session import materialize


def _counts(df: DataFrame, g: list[str], y: str, pred: str) -> DataFrame:
    yt, yp = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*g).agg(
        F.count("*").alias("n"), F.count_if(yt & yp).alias("tp"), F.count_if(~yt & yp).alias("fp"),
        F.count_if(yt & ~yp).alias("fn"), F.count_if(~yt & ~yp).alias("tn"))


def roc_auc(df: DataFrame, group_cols=(), y: str = "y_true", score: str = "proba") -> DataFrame:
    """Exact ROC AUC = (sum of positive average ranks - P(P+1)/2) / (P * N); one class -> NULL.

    Rows are counted per distinct score once; ranks run within buckets of scores, and what a bucket's positives
    owe to the buckets before it is added on the table of buckets, so no rank is joined back.
    """
    g = list(group_cols)
    scored = df.filter(F.col(score).isNotNull())
    cells = materialize(scored.groupBy(*g, score).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos")))
    buckets = rank_sums(cells, score, "n", "pos", g)
    prior = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # a row per bucket
    owed = F.coalesce(F.sum("n").over(prior), F.lit(0)) * F.col("pos")
    s = buckets.withColumn("rsum", F.col("rsum") + owed).groupBy(*g).agg(
        F.sum("rsum").alias("rsum"), F.sum("pos").alias("P"), F.sum(F.col("n") - F.col("pos")).alias("N"))
    auc = F.try_divide(F.col("rsum") - F.col("P") * (F.col("P") + 1) / 2.0, (F.col("P") * F.col("N")).cast("double"))
    return s.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0), auc).alias("roc_auc"))


def binary_metrics(df: DataFrame, group_cols=(), y: str = "y_true", pred: str = "pred", score: str = "proba") -> DataFrame:
    """roc_auc, f1, accuracy, precision, recall (zero division -> 0)."""
    g = list(group_cols)
    c = _counts(df, g, y, pred)
    tp, fp, fn, tn, n = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn", "n"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    m = c.select(*g, f1.alias("f1"), F.try_divide(tp + tn, n).alias("accuracy"), prec.alias("precision"), rec.alias("recall"))
    auc = roc_auc(df, g, y, score)
    return (m.join(auc, g) if g else m.crossJoin(auc)).select(*g, "roc_auc", "f1", "accuracy", "precision", "recall")


def confusion(df: DataFrame, group_cols=(), y: str = "y_true", pred: str = "pred") -> DataFrame:
    """Zero-filled 2 x 2 confusion counts (TN, FP, FN, TP)."""
    g = list(group_cols)
    return _counts(df, g, y, pred).select(*g, "tn", "fp", "fn", "tp")


def classification_report(df: DataFrame, group_cols=(), y: str = "y_true", pred: str = "pred",
                          names=("non-churn", "churn")) -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    g = list(group_cols)
    c = _counts(df, g, y, pred)
    tp, fp, fn, tn, n = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn", "n"))

    def cls(label, t_p, f_p, f_n, support):
        p = F.coalesce(F.try_divide(t_p, t_p + f_p), F.lit(0.0))
        r = F.coalesce(F.try_divide(t_p, t_p + f_n), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * t_p, 2 * t_p + f_p + f_n), F.lit(0.0))
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        support.cast("long").alias("support"))

    c0 = cls(names[0], tn, fn, fp, tn + fp)
    c1 = cls(names[1], tp, fp, fn, tp + fn)
    rows = c.select(*g, c0.alias("c0"), c1.alias("c1"), n.alias("n"), (tp + tn).alias("ok"))
    acc = F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.try_divide(F.col("ok"), F.col("n")).alias("f1"),
                   F.col("n").cast("long").alias("support"))

    def avg(label, w0, w1):
        tot = w0 + w1
        return F.struct(F.lit(label).alias("label"),
                        ((F.col("c0.precision") * w0 + F.col("c1.precision") * w1) / tot).alias("precision"),
                        ((F.col("c0.recall") * w0 + F.col("c1.recall") * w1) / tot).alias("recall"),
                        ((F.col("c0.f1") * w0 + F.col("c1.f1") * w1) / tot).alias("f1"),
                        F.col("n").cast("long").alias("support"))

    s0, s1 = F.col("c0.support").cast("double"), F.col("c1.support").cast("double")
    out = rows.select(*g, F.explode(F.array(F.col("c0"), F.col("c1"), acc, avg("macro avg", F.lit(1.0), F.lit(1.0)),
                                            avg("weighted avg", s0, s1))).alias("r"))
    return out.select(*g, "r.*")
