"""Dimension reduction (F14-F16, D4, A14) and univariate feature selection (D3).

PCA: the feature means are one aggregation; the covariance and its eigen-decomposition come
from ``pyspark.ml.feature.PCA`` (a distributed tree-aggregated d x d covariance) on the
centred features (Spark's PCA does not centre). Loadings are model parameters (d x k
numbers); scores are then plain column arithmetic, so scoring stays in generated code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.operators.schema import META_COLUMNS
from churnkit.session import materialize


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META_COLUMNS and c not in ("split", "is_synthetic")]


class PCAResult:
    def __init__(self, features, means, loadings, ratios, k):
        self.features = features      # list[str]
        self.means = means            # dict feature -> mean
        self.loadings = loadings      # list (per component) of list (per feature)
        self.ratios = ratios          # explained variance ratio per component (all d)
        self.k = k                    # components kept

    def scores(self, df: DataFrame, keep=("ID", "cible_churn")) -> DataFrame:
        """``PC1..PCk`` for every row (+ identifier and target)."""
        cols = [F.col(c) for c in keep if c in df.columns]
        for j in range(self.k):
            expr = sum((F.lit(float(self.loadings[j][i])) * (F.col(f).cast("double") - F.lit(float(self.means[f])))
                        for i, f in enumerate(self.features)), F.lit(0.0))
            cols.append(expr.alias(f"PC{j + 1}"))
        return df.select(*cols)

    def variance_table(self, spark) -> DataFrame:
        """per component its explained variance ratio and the running total."""
        rows = [(j + 1, float(r)) for j, r in enumerate(self.ratios)]
        t = spark.createDataFrame(rows, "component int, variance_ratio double")
        w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # d rows
        return t.withColumn("cumulative", F.sum("variance_ratio").over(w)).withColumn(
            "kept", F.col("component") <= self.k)

    def loadings_table(self, spark) -> DataFrame:
        """F16: long ``(feature, component, loading)`` for the kept components."""
        rows = [(f, j + 1, float(self.loadings[j][i])) for j in range(self.k) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature string, component int, loading double")

    def summary(self, spark, n_rows: int) -> DataFrame:
        """Rows, features in, components kept, variance explained (6 dp)."""
        total = float(sum(self.ratios[: self.k]))
        return spark.createDataFrame([(n_rows, len(self.features), self.k, round(total, 6))],
                                     "n_rows long, n_features int, n_components int, variance_explained double")


def _moments(x: np.ndarray) -> np.ndarray:
    """Of every pair of columns, over the rows that have both (missing: masked): rows, mean of the first, mean of the second, co-moment."""
    values, valid = np.ma.getdata(x), ~np.ma.getmaskarray(x)
    p = values.shape[1]
    if not np.isfinite(values[valid]).all():       # an infinite value or NaN must not reach other pairs
        out = np.zeros((4, p, p))
        for i in range(p):
            for j in range(p):
                both = valid[:, i] & valid[:, j]
                u, v = values[both, i], values[both, j]
                if len(u):
                    out[:, i, j] = len(u), u.mean(), v.mean(), ((u - u.mean()) * (v - v.mean())).sum()
        return out
    counts = valid.sum(axis=0)
    shift = np.where(valid, values, 0.0).sum(axis=0) / np.maximum(counts, 1)
    z, m = np.where(valid, values - shift, 0.0), valid.astype(float)
    n, first, second = m.T @ m, z.T @ m, m.T @ z
    some = np.maximum(n, 1)
    return np.array([n, np.where(n > 0, shift[:, None] + first / some, 0.0), np.where(n > 0, shift + second / some, 0.0), z.T @ z - first * second / some])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of both sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    u, v = b[1] - a[1], b[2] - a[2]
    both = np.array([n, a[1] + u * share, a[2] + v * share, a[3] + b[3] + u * v * a[0] * share])
    return np.where(b[0] == 0, a, np.where(a[0] == 0, b, both))


def covariances(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature1, feature2, covariance`` of every pair of features (population), in one pass.

    A task adds up its rows batch by batch, by matrix products about the batch's means; what it hands on is 4 numbers
    per pair, which are merged in one small task. A row counts for the pairs that it has both values of.
    """
    p = len(features)

    def collected(batches):
        total = np.zeros((4, p, p))
        with np.errstate(invalid="ignore", over="ignore"):
            for b in batches:
                if b.num_rows:
                    x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                    missing = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                    total = _merged(total, _moments(np.ma.array(x, mask=missing)))
        yield pa.RecordBatch.from_pydict({"moments": pa.array([total.tobytes()], pa.binary())})

    def listed(batches):
        total = np.zeros((4, p, p))
        with np.errstate(invalid="ignore", over="ignore"):
            for b in batches:
                for m in b.column(0).to_pylist():
                    total = _merged(total, np.frombuffer(m).reshape(4, p, p))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        yield pa.RecordBatch.from_pydict({"feature1": pa.array([features[i] for i, _ in pairs], pa.string()), "feature2": pa.array([features[j] for _, j in pairs], pa.string()),
                                          "covariance": pa.array([total[3, i, j] / total[0, i, j] if total[0, i, j] else None for i, j in pairs], pa.float64())})

    empty = df.sparkSession.createDataFrame([(bytearray(np.zeros((4, p, p)).tobytes()),)], "moments binary")
    found = df.select(*[F.col(f).cast("double") for f in features]).mapInArrow(collected, "moments binary")
    return found.unionByName(empty).repartition(1).mapInArrow(listed, "feature1 string, feature2 string, covariance double")     # a row per task


def spectrum_certificate(cov: DataFrame, pca: PCAResult, tolerance: float = 1e-8) -> DataFrame:
    """F16: per component, whether it is a unit vector, orthogonal to those before it, and an eigenvector of ``cov``
    (``covariances``) whose eigenvalue is its share of the trace and not above the one before.

    Checked on the two result tables (features^2 numbers) by joins; errors are measured against the trace.
    """
    spark, cov = cov.sparkSession, materialize(cov)
    load = spark.createDataFrame([(j + 1, f, float(v[i])) for j, v in enumerate(pca.loadings) for i, f in enumerate(pca.features)], "component int, feature string, v double")
    ratio = spark.createDataFrame([(j + 1, float(r)) for j, r in enumerate(pca.ratios)], "component int, ratio double")
    full = cov.unionByName(cov.filter("feature1 <> feature2").select(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "covariance"))
    trace = cov.filter("feature1 = feature2").agg(F.sum("covariance").alias("trace"))
    image = (full.join(F.broadcast(load.withColumnRenamed("feature", "feature2")), "feature2").groupBy("component", F.col("feature1").alias("feature"))
             .agg(F.sum(F.col("covariance") * F.col("v")).alias("cv")))
    residual = (image.join(load, ["component", "feature"]).join(ratio, "component").crossJoin(trace)   # trace: one row
                .groupBy("component").agg(F.max(F.abs(F.col("cv") - F.col("ratio") * F.col("trace") * F.col("v")) / F.col("trace")).alias("residual")))
    other = load.select(F.col("component").alias("other"), "feature", F.col("v").alias("u"))
    dots = (load.join(other, "feature").filter("other <= component").groupBy("component", "other").agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
            .groupBy("component").agg(F.max(F.abs(F.col("dot") - (F.col("component") == F.col("other")).cast("double"))).alias("skew")))
    before = Window.orderBy("component")   # a row per component
    falling = ratio.withColumn("falling", F.col("ratio") <= F.coalesce(F.lag("ratio").over(before), F.lit(1.0)) + tolerance)
    return (residual.join(dots, "component").join(falling, "component")
            .select("component", (F.col("residual") <= tolerance).alias("is_eigenvector"), (F.col("skew") <= tolerance).alias("is_orthonormal"), F.col("falling").alias("is_falling")))


def fit_pca(df: DataFrame, features: list[str] | None = None, variance: float = 0.95,
            n_components: int | None = None) -> PCAResult:
    """PCA on the centred features; keep the fewest components reaching ``variance``
    (or exactly ``n_components``). Each component's sign makes its largest |loading| positive."""
    features = features or feature_columns(df)
    means_row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    means = {f: float(means_row[f] or 0.0) for f in features}
    centred = df.select(*[(F.col(f).cast("double") - F.lit(means[f])).alias(f) for f in features])
    vec = VectorAssembler(inputCols=features, outputCol="v").transform(centred)
    d = len(features)
    model = PCA(k=d, inputCol="v", outputCol="pcs").fit(vec)
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    pc = model.pc.toArray()            # d x d, columns = components
    loadings = []
    for j in range(d):
        col = [float(pc[i][j]) for i in range(d)]
        big = max(range(d), key=lambda i: abs(col[i]))
        if col[big] < 0:
            col = [-x for x in col]
        loadings.append(col)
    if n_components is not None:
        k = min(n_components, d)
    else:
        k, acc = d, 0.0
        for j, r in enumerate(ratios):
            acc += r
            if acc >= variance - 1e-12:
                k = j + 1
                break
    return PCAResult(features, means, loadings, ratios, k)


def anova_f_scores(df: DataFrame, features: list[str], target: str = "cible_churn") -> DataFrame:
    """D3 (scores): one-way ANOVA F of each feature across the target classes, in one grouped
    aggregation (per class count, mean and population variance of every feature)."""
    aggs = [F.count("*").alias("cnt")]
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.avg(x).alias(f"m_{f}"), F.var_pop(x).alias(f"v_{f}")]
    per = df.groupBy(target).agg(*aggs)
    tot_aggs = [F.sum("cnt").alias("_N"), F.count("*").alias("_K")]
    for f in features:
        tot_aggs.append((F.sum(F.col("cnt") * F.col(f"m_{f}")) / F.sum("cnt")).alias(f"g_{f}"))
    tot = per.agg(*tot_aggs)
    j = per.crossJoin(tot)   # classes x 1
    ss = []
    for f in features:
        ss += [F.sum(F.col("cnt") * F.pow(F.col(f"m_{f}") - F.col(f"g_{f}"), 2)).alias(f"b_{f}"),
               F.sum(F.col("cnt") * F.col(f"v_{f}")).alias(f"w_{f}")]
    s = j.groupBy("_N", "_K").agg(*ss)
    rows = [F.struct(F.lit(f).alias("feature"),
                     F.try_divide(F.try_divide(F.col(f"b_{f}"), F.col("_K") - 1), F.try_divide(F.col(f"w_{f}"), F.col("_N") - F.col("_K"))).alias("f_score"))
            for f in features]
    return s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def select_k_best(df: DataFrame, features: list[str], k: int = 10, target: str = "cible_churn") -> DataFrame:
    """D3: ANOVA F per feature and the ``selected`` flag for the k best (ties -> feature name)."""
    sc = anova_f_scores(df, features, target)
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("feature"))   # one row per feature
    return sc.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("selected", F.col("rank") <= k)
