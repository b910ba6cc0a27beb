"""Certificates of fitted classifiers: what the optimum must satisfy, recomputed from the rows by grouped sums.

A fit is checked without fitting again. At the optimum of a penalised linear model the gradient vanishes: per
feature, one aggregation over the rows gives the data's moment (known without the model) and the gradient that
the returned weights leave. A greedy tree is checked through its node table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.operators.margins import logistic, value
from churnkit.operators.models import TARGET, FittedModel
from churnkit.session import checkpoint_dir

INTERCEPT = "intercept"


def _linear(weights: list[float], inputs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * x for w, x in zip(weights, inputs)])


def _certificate(rows: DataFrame, model: str, names: list[str], inputs: list[Column], target: Column, pull: Column, penalty: list[float], weight: Column, bound: float) -> DataFrame:
    """One row per weight: ``model``, ``feature``, ``n_rows``, ``observed`` (sum of weight x target x input), ``stationary``.

    The gradient of a weight is ``penalty - sum(weight * pull * input)``; it is stationary if its size is at most
    ``bound`` per unit of weight. One aggregation, one row per weight; no rows: no weight is stationary.
    """
    sums = [F.count("*").alias("n"), F.sum(weight).alias("total")]
    sums += [F.sum(weight * target * x).alias(f"o{j}") for j, x in enumerate(inputs)]
    sums += [F.sum(weight * pull * x).alias(f"g{j}") for j, x in enumerate(inputs)]
    found = rows.agg(*sums)
    cells = [F.struct(F.lit(f).alias("feature"), F.col("n").alias("n_rows"), F.col(f"o{j}").alias("observed"),
                      F.coalesce(F.abs(F.lit(penalty[j]) - F.col(f"g{j}")) <= F.lit(bound) * F.col("total"), F.lit(False)).alias("stationary"))
             for j, f in enumerate(names)]
    return found.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(model).alias("model"), "c.*")


def logistic_certificate(rows: DataFrame, fitted: FittedModel, y: str = TARGET, weight: Column | None = None, bound: float = 1e-4) -> DataFrame:
    """M4: stationarity of a logistic regression with penalty ``|b|^2 / (2 C)`` (the intercept is free).

    ``rows`` are the training rows, ``weight`` their weight (1 if not given); rows without target are left out and
    missing features count as 0. See ``_certificate`` for the columns.
    """
    model = fitted.model.stages[-1]
    b = [float(w) for w in model.coefficients] + [float(model.intercept)]
    inputs = [value(f) for f in fitted.features] + [F.lit(1.0)]
    target = F.col(y).cast("double")
    c = float(fitted.params.get("C", 1.0))
    penalty = [w / c for w in b[:-1]] + [0.0]
    return _certificate(rows.filter(target.isNotNull()), "logreg", [*fitted.features, INTERCEPT], inputs, target,
                        target - logistic(_linear(b, inputs)), penalty, F.lit(1.0) if weight is None else weight, bound)


def margin_certificate(rows: DataFrame, features: list[str], weights: list[float], c: float, y: str = TARGET, weight: Column | None = None, bound: float = 1e-7) -> DataFrame:
    """M5: stationarity of a squared-hinge SVM (``margins.fit_margins``; the intercept, last, is penalised too).

    The target is 1 or -1. Rows without target are left out, missing features count as 0.
    """
    inputs = [value(f) for f in features] + [F.lit(1.0)]
    target = 2.0 * F.col(y).cast("double") - 1.0
    short = F.greatest(1.0 - target * _linear(weights, inputs), F.lit(0.0))
    return _certificate(rows.filter(target.isNotNull()), "svm", [*features, INTERCEPT], inputs, target,
                        2.0 * c * short * target, list(weights), F.lit(1.0) if weight is None else weight, bound)


def tree_nodes(fitted: FittedModel) -> DataFrame:
    """M1: node table of a fitted tree: ``id`` (preorder), ``left``, ``right`` (-1: a leaf), ``feature``, ``threshold``,
    ``n_rows``, ``n_churn``, ``impurity``, ``gain`` (null for leaves, like feature and threshold)."""
    import uuid
    tree = fitted.model.stages[-1]
    spark = SparkSession.active()
    path = f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    tree.write().save(path)
    inner = F.col("leftChild") >= 0
    names = F.array(*[F.lit(f) for f in fitted.features])
    return spark.read.parquet(f"{path}/data").select(
        "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(inner, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.aggregate("impurityStats", F.lit(0.0), lambda a, b: a + b).cast("long").alias("n_rows"),
        F.get("impurityStats", F.lit(1)).cast("long").alias("n_churn"), "impurity", F.when(inner, F.col("gain")).alias("gain"))


def top_splits(nodes: DataFrame) -> DataFrame:
    """The root and its two children by place (``root``, ``left``, ``right``): ``n_rows``, ``n_churn``, ``feature``, ``gain``."""
    root = F.broadcast(nodes.filter("id = 0").select(F.col("left").alias("l"), F.col("right").alias("r")))   # one row
    place = F.when(F.col("id") == 0, "root").when(F.col("id") == F.col("l"), "left").when(F.col("id") == F.col("r"), "right")
    return nodes.crossJoin(root).withColumn("node", place).filter("node is not null").select("node", "n_rows", "n_churn", "feature", "gain")
