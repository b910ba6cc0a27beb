"""Univariate profiles (A1-A3) and side-by-side descriptives of two tables.

All columns are profiled together: the moments in one wide aggregation (map-side partial
aggregates, one tiny final merge), the quantiles and modes from a long ``(colonne, value)``
form grouped by column, so the work is spread by column *and* by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from churnkit.functions.ranks import exact_quantiles
from churnkit.functions.scalar import number
from churnkit.operators.schema import columns_without_id, split_quant_qual

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

QUANT_SCHEMA = StructType([
    StructField("colonne", StringType()), StructField("n", LongType()), StructField("n_non_null", LongType()),
    StructField("mean", DoubleType()), StructField("median", DoubleType()), StructField("std", DoubleType()),
    StructField("var", DoubleType()), StructField("min", DoubleType()), StructField("max", DoubleType()),
    StructField("q25", DoubleType()), StructField("q50", DoubleType()), StructField("q75", DoubleType()),
    StructField("iqr", DoubleType()),
])


def _rows_from_wide(wide: DataFrame, cols: list[str], fields: list[str], label: str = "colonne") -> DataFrame:
    """Turn one wide row ``{col}__{field}`` into one row per column."""
    keep = [F.col("__n").alias("n")] if "__n" in wide.columns else []
    structs = [F.struct(F.lit(c).alias(label), *keep, *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def long_form(df: DataFrame, cols: list[str], value_type: str, ids=(), name: str = "colonne",
              value: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to one type) into ``(*ids, name, value)``; NULLs are kept."""
    value_of = number if value_type == "double" else (lambda c: F.col(c).cast(value_type))
    sel = [F.col(i) for i in ids] + [value_of(c).alias(c) for c in cols]
    return df.select(*sel).unpivot(list(ids), cols, name, value)


def quantitative_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A1: n, n_non_null, mean, median, std/var (ddof=1), min, max, quartiles, IQR per column."""
    if cols is None:
        cols = split_quant_qual(df)[0]
    if not cols:
        return df.sparkSession.createDataFrame([], QUANT_SCHEMA)
    aggs = [F.count("*").alias("__n")]
    for c in cols:
        x = number(c)
        aggs += [F.count(x).alias(f"{c}__n_non_null"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.var_samp(x).alias(f"{c}__var"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    moments = _rows_from_wide(df.agg(*aggs), cols, ["n_non_null", "mean", "std", "var", "min", "max"])
    q = exact_quantiles(long_form(df, cols, "double"), "value", QUARTILES, ["colonne"])
    out = moments.join(q, "colonne", "left")
    return out.select(
        "colonne", "n", F.col("n_non_null").cast("long").alias("n_non_null"), "mean",
        F.col("q50").alias("median"), "std", "var", "min", "max", "q25", "q50", "q75",
        (F.col("q75") - F.col("q25")).alias("iqr"))


def qualitative_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: n, n_non_null, number of levels, mode (ties -> smallest value), mode count."""
    if cols is None:
        cols = split_quant_qual(df)[1]
    counts = (long_form(df, cols, "string").filter(F.col("value").isNotNull())
              .groupBy("colonne", "value").agg(F.count("*").alias("cnt")))
    per_col = counts.groupBy("colonne").agg(
        F.count("*").alias("n_modalites"), F.max("cnt").alias("effectif_mode"),
        F.min(F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v")))["v"].alias("mode"))
    aggs = [F.count("*").alias("__n")] + [F.count(F.col(c)).alias(f"{c}__n_non_null") for c in cols]
    wide = df.agg(*aggs)
    base = _rows_from_wide(wide, cols, ["n_non_null"])
    return (base.join(per_col, "colonne", "left")
            .select("colonne", "n", F.col("n_non_null").cast("long").alias("n_non_null"),
                    F.coalesce(F.col("n_modalites"), F.lit(0)).cast("long").alias("n_modalites"),
                    "mode", F.coalesce(F.col("effectif_mode"), F.lit(0)).cast("long").alias("effectif_mode")))


def univariate_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: one row per column (identifier excluded), quantitative or qualitative profile."""
    cols = columns_without_id(df) if cols is None else cols
    quant, qual = split_quant_qual(df, cols)
    parts = []
    if quant:
        parts.append(quantitative_profile(df, quant).withColumn("type", F.lit("quantitatif")))
    if qual:
        parts.append(qualitative_profile(df, qual).withColumn("type", F.lit("qualitatif")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compare_numeric_descriptives(t1: DataFrame, t2: DataFrame, cols: list[str]) -> DataFrame:
    """Count, median, mean of each common numeric column on both sides.

    A column empty on either side (or missing from either table) is skipped.
    """
    cols = [c for c in cols if c in t1.columns and c in t2.columns]
    both = (long_form(t1, cols, "double", name="variable").withColumn("side", F.lit("table1"))
            .unionByName(long_form(t2, cols, "double", name="variable").withColumn("side", F.lit("table2")))
            .filter(F.col("value").isNotNull()))
    stats = both.groupBy("variable", "side").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    med = exact_quantiles(both, "value", {"median": 0.5}, ["variable", "side"])
    s = stats.join(med, ["variable", "side"])
    wide = s.groupBy("variable").pivot("side", ["table1", "table2"]).agg(
        F.first("n").alias("n"), F.first("median").alias("median"), F.first("mean").alias("mean"))
    return (wide.filter(F.col("table1_n").isNotNull() & F.col("table2_n").isNotNull())
            .select("variable", F.col("table1_n").alias("n_table1"), F.col("table2_n").alias("n_table2"),
                    F.col("table1_median").alias("median_table1"), F.col("table2_median").alias("median_table2"),
                    F.col("table1_mean").alias("mean_table1"), F.col("table2_mean").alias("mean_table2")))
