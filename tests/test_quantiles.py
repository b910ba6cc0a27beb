"""Quantiles by narrowing intervals: against the position table and pandas, with hot values, wide ranges and odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.functions import ranks
from churnkit.functions.ranks import exact_quantiles

PROBS = {"p0": 0.0, "p01": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}


def table(df):
    return {tuple(r[:-len(PROBS)]): list(r[-len(PROBS):]) for r in df.collect()}


@pytest.mark.parametrize("few,bins", [(2000, 1024), (3, 4)])
def test_like_numpy(spark, monkeypatch, few, bins):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "BINS", bins)
    draw = np.random.default_rng(2)
    parts = {"normal": draw.normal(size=5000), "hot": np.r_[np.zeros(3000), draw.normal(size=900), np.full(1500, 7.5)], "wide": np.exp(draw.normal(size=2000) * 8),
             "one": np.array([3.25]), "two": np.array([-1.0, 5.0]), None: np.array([1.0, 1.0, 2.0])}
    rows = [(k, float(x)) for k, v in parts.items() for x in v] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = table(exact_quantiles(df, "v", PROBS, ["g"]))
    assert set(got) == {(k,) for k in parts}
    for k, v in parts.items():
        assert got[(k,)] == pytest.approx(np.quantile(v, list(PROBS.values())).tolist(), rel=1e-12, abs=1e-12)
    assert got == table(ranks._quantiles_by_position(df, "v", PROBS, ["g"]))


def test_odd_values_and_nothing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (float("nan"),)], "v double")
    assert exact_quantiles(df, "v", {"q": 0.25}).first()["q"] == 1.75
    wide = spark.createDataFrame([(x,) for x in (-1.7e308, 0.0, 1.0, 1.7e308)], "v double")     # the width is not finite
    assert exact_quantiles(wide, "v", {"a": 0.0, "b": 1 / 3, "c": 2 / 3, "d": 1.0}).first()[1] == pytest.approx(0.0, abs=1e300)
    none = df.filter("v < 0")
    assert [tuple(r) for r in exact_quantiles(none, "v", {"q": 0.5}).collect()] == [(None,)]
    assert exact_quantiles(none.withColumn("g", F.lit(1)), "v", {"q": 0.5}, ["g"]).count() == 0


def test_many_groups_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(ranks, "GROUPS", 3)
    df = spark.range(40).select((F.col("id") % 8).alias("g"), F.col("id").cast("double").alias("v"))
    assert {r["g"]: r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {i: 16.0 + i for i in range(8)}
