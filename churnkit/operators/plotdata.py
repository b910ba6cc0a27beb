"""The numbers behind the exploration charts (G1-G6) and contingency tables (A10).

Charts themselves are not drawn; each operator returns the aggregated table a chart needs,
computed by Spark (binned counts, top-k categories, box statistics), never the raw points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.ranks import exact_quantiles


def _bin(x: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Equal-width bin 0..bins-1 of x in [lo, hi], last bin right-closed (NumPy convention)."""
    return F.least(F.floor((x - lo) * bins / (hi - lo)), bins - 1).cast("int")


def _range(df: DataFrame, col: str) -> DataFrame:
    """One row: n, lo, hi (a constant column gets the range value +- 0.5)."""
    x = F.col(col).cast("double")
    s = df.agg(F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx"))
    same = F.col("mn") == F.col("mx")
    return s.select("n", F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                    F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))


def histogram(df: DataFrame, col: str, max_bins: int = 50, min_bins: int = 10) -> DataFrame:
    """G1: every bin (empty ones included) with its edges and count.

    Bin count = min(max_bins, max(min_bins, floor(sqrt(n)))) over the non-null values.
    """
    r = _range(df, col).withColumn(
        "bins", F.least(F.lit(max_bins), F.greatest(F.lit(min_bins), F.floor(F.sqrt("n")).cast("int"))))
    x = F.col(col).cast("double")
    counted = (df.select(x.alias("x")).filter(F.col("x").isNotNull()).crossJoin(F.broadcast(r))   # r: one row
               .groupBy(_bin(F.col("x"), F.col("lo"), F.col("hi"), F.col("bins")).alias("bin"))
               .agg(F.count("*").alias("n")))
    all_bins = r.filter(F.col("n") > 0).select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return (all_bins.join(counted, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def top_categories(df: DataFrame, col: str, k: int = 40) -> DataFrame:
    """The k most frequent values (ties: smallest value first) with their rank.

    The limit is the feature (a bar chart of the top k); the counts cover every row.
    """
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())   # over k rows only
    return top.withColumn("rank", F.row_number().over(w))


def scatter_bins(df: DataFrame, x_col: str, y_col: str, bins: int = 20) -> DataFrame:
    """2-D binned counts of the complete pairs (a density scatter)."""
    d = df.select(F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y")).na.drop()
    rx = _range(d, "x").select(F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    ry = _range(d, "y").select(F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
    b = F.lit(bins)
    return (d.crossJoin(F.broadcast(rx.crossJoin(ry)))   # one row
            .groupBy(_bin(F.col("x"), F.col("xlo"), F.col("xhi"), b).alias("bin_x"),
                     _bin(F.col("y"), F.col("ylo"), F.col("yhi"), b).alias("bin_y"))
            .agg(F.count("*").alias("n")))


def box_stats(df: DataFrame, value_col: str, group_col: str, k: int = 35, whisker: float = 1.5) -> DataFrame:
    """Per group of the k largest groups: n, quartiles, and whiskers (most extreme values
    inside Q1 - 1.5 IQR .. Q3 + 1.5 IQR); outliers are not listed."""
    d = df.select(F.col(group_col).cast("string").alias("grp"), F.col(value_col).cast("double").alias("x")).na.drop()
    groups = d.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("grp")).limit(k)
    kept = d.join(F.broadcast(groups.select("grp")), "grp")   # k rows
    q = exact_quantiles(kept, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["grp"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("grp", "q1", "median", "q3", (F.col("q1") - whisker * iqr).alias("lo"),
                      (F.col("q3") + whisker * iqr).alias("hi"))
    wh = (kept.join(F.broadcast(fences), "grp")
          .groupBy("grp").agg(F.min(F.when(F.col("x") >= F.col("lo"), F.col("x"))).alias("whisker_low"),
                              F.max(F.when(F.col("x") <= F.col("hi"), F.col("x"))).alias("whisker_high")))
    out = groups.join(fences.drop("lo", "hi"), "grp").join(wh, "grp")
    # The chart label is the category text cut to 20 characters
    return out.withColumn("label", F.substring("grp", 1, 20)).withColumnRenamed("grp", group_col)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10: sparse contingency table ``(a, b, n)`` of the complete pairs."""
    return (df.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b)).na.drop()
            .groupBy(a, b).agg(F.count("*").alias("n")))


def contingency_bars(df: DataFrame, a: str, b: str, top_rows: int = 25, top_cols: int = 15) -> DataFrame:
    """Stacked-bar data: the ``top_rows`` most frequent values of ``a``; among their rows,
    the ``top_cols`` most frequent values of ``b`` (columns ranked after the row cut)."""
    cells = contingency(df, a, b)
    rows = (cells.groupBy(a).agg(F.sum("n").alias("_rn")).orderBy(F.col("_rn").desc(), F.col(a)).limit(top_rows))
    kept = cells.join(F.broadcast(rows.select(a)), a)   # top_rows rows
    cols = kept.groupBy(b).agg(F.sum("n").alias("_cn")).orderBy(F.col("_cn").desc(), F.col(b)).limit(top_cols)
    return kept.join(F.broadcast(cols.select(b)), b).select(a, b, "n")
