"""Classifiers (M1-M6): Spark ML estimators for trees, forests and logistic regression, a calibrated
squared-hinge SVM (``margins.py``) and a categorical naive Bayes built from grouped counts.

Estimators train on an assembled feature vector (``VectorAssembler`` at the ML edge only); rows that
already carry a ``features`` vector are used as they are, so many fits can share one assembled table.
The categorical naive Bayes has no Spark built-in: it is fitted with one grouped count
over the long form of the training rows, and scores rows with map lookups against a
one-row model table (bounded by the number of categories), so scoring needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit.operators import forests
from churnkit.operators.margins import FOLDS, MarginModel, calibrate, fit_margins
from churnkit.operators.profile import long_form
from churnkit.operators.schema import features_for_mode

TARGET = "cible_churn"
SEED = 42
SPARK_MAX_DEPTH = 30        # deepest tree Spark accepts; stands for "unlimited"


# ---- class weights (M6) -----------------------------------------------------------------

def with_balanced_weights(df: DataFrame, y: str = TARGET, out: str = "weight", how: str = "inner") -> DataFrame:
    """M6: ``n / (n_classes * n_c)`` per row (``class_weight='balanced'``); ``how='left'`` keeps rows without a class, without a weight."""
    counts = df.groupBy(y).agg(F.count("*").alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count("*").alias("_k"))
    w = counts.crossJoin(tot).select(y, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), y, how)   # one row per class


def with_unit_weights(df: DataFrame, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.lit(1.0))


def code(column: str) -> Column:
    """Integer category code, negative ones as 0; an unknown category stays NULL."""
    c = F.col(column).cast("int")
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0)))


# ---- categorical naive Bayes (M3) ---------------------------------------------------------

@dataclass
class CategoricalNBModel:
    features: list[str]
    alpha: float
    table: DataFrame                  # one row: priors, per class x feature a value->log-prob map and a default
    classes: tuple = (0, 1)

    def jll(self, c: int) -> Column:
        total = F.col(f"prior_{c}")
        for f in self.features:
            x = code(f)
            total = total + F.coalesce(F.element_at(F.col(f"map_{c}_{f}"), x), F.col(f"def_{c}_{f}"))
        return total

    def transform(self, df: DataFrame, keep=("ID",)) -> DataFrame:
        """Adds ``pred`` (most probable class, ties -> 0) and ``proba`` (P(class 1))."""
        d = df.crossJoin(F.broadcast(self.table))
        j0, j1 = self.jll(0), self.jll(1)
        d = d.select(*[F.col(k) for k in keep if k in df.columns], j0.alias("_j0"), j1.alias("_j1"))
        return d.select(*[k for k in keep if k in df.columns],
                        (F.col("_j1") > F.col("_j0")).cast("int").alias("pred"),
                        (1.0 / (1.0 + F.exp(F.col("_j0") - F.col("_j1")))).alias("proba"))


def nb_counts(train: DataFrame, features: list[str], y: str = TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What every smoothing shares: rows per (class, feature, code), per class, and codes per feature (max code + 1)."""
    from churnkit.session import materialize
    d = train.select(F.col(y).cast("int").alias("_y"), *[code(f).alias(f) for f in features])
    long = long_form(d, features, "int", ids=["_y"], name="feature").filter(F.col("value").isNotNull())
    counts = materialize(long.groupBy("_y", "feature", "value").agg(F.count("*").cast("double").alias("n")))
    k = counts.groupBy("feature").agg((F.max("value") + 1).cast("double").alias("K"))
    return counts, materialize(d.groupBy("_y").agg(F.count("*").cast("double").alias("ny"))), k


def fit_categorical_nb(train: DataFrame, features: list[str], alpha: float = 1.0, y: str = TARGET, counts=None) -> CategoricalNBModel:
    """M3: log P(v | c, f) = log((n_cfv + alpha) / (n_c + alpha * K_f)), K_f = max code + 1;
    priors from class frequencies. An unseen code falls back to n_cfv = 0. ``counts``: what ``nb_counts`` gave."""
    counts, ny, k = counts or nb_counts(train, features, y)
    n_all = ny.agg(F.sum("ny").alias("N"))
    base = ny.crossJoin(k)   # classes x features: small
    a = F.lit(float(alpha))
    logp = (counts.join(base, ["_y", "feature"])
            .select("_y", "feature", "value", F.log((F.col("n") + a) / (F.col("ny") + a * F.col("K"))).alias("lp")))
    maps = logp.groupBy("_y", "feature").agg(F.map_from_entries(F.collect_list(F.struct("value", "lp"))).alias("m"))
    defaults = base.select("_y", "feature", F.log(a / (F.col("ny") + a * F.col("K"))).alias("d"))
    pieces = maps.join(defaults, ["_y", "feature"], "right")
    row_aggs = []
    for c in (0, 1):
        for f in features:
            sel = (F.col("_y") == c) & (F.col("feature") == f)
            row_aggs += [F.first(F.when(sel, F.col("m")), ignorenulls=True).alias(f"map_{c}_{f}"),
                         F.first(F.when(sel, F.col("d")), ignorenulls=True).alias(f"def_{c}_{f}")]
    table = pieces.agg(*row_aggs)
    priors = ny.crossJoin(n_all).agg(
        *[F.first(F.when(F.col("_y") == c, F.log(F.col("ny") / F.col("N"))), ignorenulls=True).alias(f"prior_{c}") for c in (0, 1)])
    from churnkit.session import materialize
    return CategoricalNBModel(features, alpha, materialize(table.crossJoin(priors)))


# ---- Spark ML estimators (M1, M2, M4, M5) ---------------------------------------------------

def _depth(v) -> int:
    return SPARK_MAX_DEPTH if v is None else int(v)


@dataclass
class FittedModel:
    key: str
    params: dict
    features: list[str]
    model: object = None                       # PipelineModel (assembler, classifier), CategoricalNBModel or forests.Forest
    calibrated: list[MarginModel] = field(default_factory=list)   # M5: one model per calibration fold

    def transform(self, df: DataFrame, keep=("ID",)) -> DataFrame:
        """Scored rows: ``keep`` columns + ``pred`` + ``proba``."""
        keep = [k for k in keep if k in df.columns]
        if isinstance(self.model, CategoricalNBModel):
            return self.model.transform(df, keep)
        if isinstance(self.model, forests.Forest):
            return forests.voted(self.model, assembled(df, self.features), keep)
        if self.key == "svm":
            # average calibrated probability over the folds: one projection, so it also runs on a stream
            avg = sum((m.probability(self.features) for m in self.calibrated), F.lit(0.0)) / len(self.calibrated)
            return df.select(*keep, avg.alias("proba")).select(*keep, (F.col("proba") > 0.5).cast("int").alias("pred"), "proba")
        out = (self.model.stages[-1] if "features" in df.columns else self.model).transform(df)
        return out.select(*keep, F.col("prediction").cast("int").alias("pred"),
                          vector_to_array("probability")[1].alias("proba"))


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return df if "features" in df.columns else _assembler(features).transform(df)


def build_estimator(key: str, params: dict, n_rows: float | None = None):
    """Spark estimator for an algorithm key (unknown keys are rejected).

    Trees and forests keep each row's node in a column instead of shipping the growing trees with every task; a forest keeps
    many nodes' histograms at once: a level of a deep forest is then one pass.
    """
    cw = params.get("class_weight")
    if key == "tree":
        return DecisionTreeClassifier(labelCol=TARGET, featuresCol="features", seed=SEED,
                                      maxDepth=_depth(params.get("max_depth")),
                                      impurity=params.get("criterion", "gini"),
                                      minInstancesPerNode=int(params.get("min_samples_leaf", 1)), maxBins=64,
                                      cacheNodeIds=True)
    if key == "rf":
        rf = RandomForestClassifier(labelCol=TARGET, featuresCol="features", seed=SEED,
                                    numTrees=int(params.get("n_estimators", 100)),
                                    maxDepth=_depth(params.get("max_depth")),
                                    featureSubsetStrategy=params.get("max_features", "sqrt"), maxBins=64,
                                    cacheNodeIds=True, maxMemoryInMB=1024)
        return rf.setWeightCol("weight") if cw == "balanced" else rf
    if key == "logreg":
        c = float(params.get("C", 1.0))
        return LogisticRegression(labelCol=TARGET, featuresCol="features", maxIter=5000, elasticNetParam=0.0,
                                  regParam=1.0 / (c * (n_rows or 1.0)), standardization=False,
                                  weightCol="weight")
    raise ValueError(f"unknown algorithm {key!r}")


def _weighted(df: DataFrame, params: dict) -> DataFrame:
    """Rows with the weights that ``params`` ask for; assembled rows may carry the balanced ones (counted once for many fits)."""
    if params.get("class_weight") != "balanced":
        return with_unit_weights(df)
    return df.filter(F.col("weight").isNotNull()) if {"features", "weight"} <= set(df.columns) else with_balanced_weights(df)


def fit_model(key: str, params: dict, train: DataFrame, mode: str | None = None, features: list[str] | None = None) -> FittedModel:
    """Fit one algorithm on the training rows (feature set from the mode: ``z`` or ``cat``).

    Rows with a ``features`` vector of ``features`` (assembled once for many fits) are not assembled again.
    """
    mode = mode or ("cat" if key == "cnb" else "z")
    features = features or sorted(features_for_mode(train, mode))
    if key == "cnb":
        return FittedModel(key, params, features, fit_categorical_nb(train, features, float(params.get("alpha", 1.0))))
    if key == "svm":
        return fit_svms([params], train, features)[0]
    data = _weighted(train, params)
    n = data.agg(F.sum("weight")).first()[0] if key == "logreg" else None
    model = build_estimator(key, params, n).fit(assembled(data, features))
    return FittedModel(key, params, features, PipelineModel(stages=[_assembler(features), model]))


def fit_svms(grid: list[dict], train: DataFrame, features: list[str], folds: int = FOLDS) -> list[FittedModel]:
    """M5 for several parameter sets at once: per fold a squared-hinge SVM on the other folds, and Platt's
    calibration on the held-out margins; probabilities are averaged over the folds."""
    from churnkit.operators.split import md5_order_key
    from churnkit.session import materialize
    d = with_balanced_weights(train).withColumn("_fold", F.pmod(md5_order_key("ID", SEED), F.lit(folds)).cast("int"))
    d = materialize(d.select(TARGET, "weight", "_fold", *features))
    models = [{"C": float(p.get("C", 1.0)), "balanced": p.get("class_weight") == "balanced", "without": k} for p in grid for k in range(folds)]
    fitted = fit_margins(d, features, models, y=TARGET, fold="_fold", folds=folds)
    calibrate(d, features, fitted, [m["without"] for m in models], y=TARGET, fold="_fold")
    return [FittedModel("svm", p, features, None, fitted[i * folds:(i + 1) * folds]) for i, p in enumerate(grid)]


# ---- nested trees: one deep fit serves every depth ------------------------------------------

def cut_leaves(nodes: pa.Table, depths: list[int | None]) -> dict[int | None, tuple[list[int], list[float]]]:
    """For each depth: (predictions, P(1)) that the leaves' rows get from the tree cut at that depth.

    ``nodes``: columns of a saved tree (prediction, impurityStats, leftChild, rightChild) by id, which is preorder; leaves
    are numbered from left to right. A greedy tree of limited depth is the deep tree cut there; like Spark, sister
    leaves with one prediction are merged into their parent.
    """
    n = nodes.num_rows
    prediction, left, right = (nodes[c].to_numpy().astype(int).tolist() for c in ("prediction", "leftChild", "rightChild"))
    stats = nodes["impurityStats"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    share = (stats[:, 1] / stats.sum(axis=1) if stats.shape[1] > 1 else np.zeros(n)).tolist()
    depth, parent = [0] * n, [-1] * n
    for i in range(n):
        for c in (left[i], right[i]):
            if c >= 0:
                depth[c], parent[c] = depth[i] + 1, i
    out = {}
    for limit in depths:
        leaf = [left[i] < 0 or (limit is not None and depth[i] >= limit) for i in range(n)]
        for i in range(n - 1, -1, -1):
            if not leaf[i]:
                leaf[i] = leaf[left[i]] and leaf[right[i]] and prediction[left[i]] == prediction[right[i]]
        held, ends = [0] * n, []
        for i in range(n):                 # a node's rows end in its highest ancestor that is a leaf
            up = parent[i]
            held[i] = held[up] if up >= 0 and leaf[held[up]] else i
            if left[i] < 0:
                ends.append(held[i])
        out[limit] = [prediction[i] for i in ends], [share[i] for i in ends]
    return out


def score_depths(model: FittedModel, df: DataFrame, depths: list[int | None], path: str, keep=("ID",)) -> DataFrame:
    """Rows scored by the tree ``model`` cut at each of ``depths``: ``keep`` + ``depth_index``, ``pred``, ``proba``.

    One pass finds each row's leaf; what a leaf becomes at each depth is a table with a row per leaf (the node table,
    written to ``path``, is as large as the model; only the columns that say how to cut it are read, as Arrow).
    """
    spark = df.sparkSession
    tree = model.model.stages[-1]
    tree.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").orderBy("id").select("prediction", "impurityStats", "leftChild", "rightChild").toArrow()
    cuts = cut_leaves(nodes, depths)
    columns = {"leaf": pa.array(np.arange(len(cuts[depths[0]][0]), dtype=float))}
    for j, d in enumerate(depths):
        columns |= {f"pred{j}": pa.array(cuts[d][0], pa.int32()), f"proba{j}": pa.array(cuts[d][1], pa.float64())}
    table = spark.createDataFrame(pa.table(columns))
    each = F.array(*[F.struct(F.col(f"pred{j}").alias("pred"), F.col(f"proba{j}").alias("proba")) for j in range(len(depths))])
    found = tree.copy().setLeafCol("leaf").transform(assembled(df, model.features))
    scored = found.select(*keep, "leaf").join(table, "leaf").select(*keep, F.posexplode(each).alias("depth_index", "c"))
    return scored.select(*keep, "depth_index", "c.pred", "c.proba")


def feature_importance(m: FittedModel) -> list[tuple[str, float]]:
    """M16 inputs: importances (trees/forest), coefficients (logistic), mean SVM coefficients
    over the calibration folds; empty when the model exposes neither."""
    if isinstance(m.model, forests.Forest):
        return list(zip(m.features, map(float, forests.importances(m.model))))
    if m.key in ("tree", "rf"):
        imp = m.model.stages[-1].featureImportances.toArray()
        return list(zip(m.features, map(float, imp)))
    if m.key == "logreg":
        return list(zip(m.features, map(float, m.model.stages[-1].coefficients.toArray())))
    if m.key == "svm" and m.calibrated:
        mean = [float(sum(c.weights[i] for c in m.calibrated) / len(m.calibrated)) for i in range(len(m.features))]
        return list(zip(m.features, mean))
    return []
