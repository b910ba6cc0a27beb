"""Structured Streaming scoring gives the same scores as the batch path."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    from churnkit.catalog import _current_members, matrix_split, prepared_union
    from churnkit.operators.models import fit_model
    from churnkit.operators.recode import fit_recode
    from churnkit.operators.score import score_rows
    from churnkit.streaming.scoring import start_scoring_stream
    recode = fit_recode(prepared_union(spark, SF))
    train = matrix_split(spark, SF).filter(F.col("split") == "train").drop("split")
    model = fit_model("logreg", {"C": 1.0}, train)
    rows = _current_members(spark, SF)
    base = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    rows.write.mode("overwrite").parquet(os.path.join(base, "in"))
    q = start_scoring_stream(spark, os.path.join(base, "in"), rows.schema, recode, model,
                             os.path.join(base, "out"), os.path.join(base, "chk"), max_files_per_trigger=1)
    q.awaitTermination()
    streamed = {r["ID"]: r["proba"] for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    batch = {r["ID"]: r["proba"] for r in score_rows(rows, recode, model).collect()}
    assert streamed.keys() == batch.keys() and len(batch) > 0
    for k, v in batch.items():
        assert streamed[k] == pytest.approx(v, rel=1e-12)
