"""Labelled training rows of the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.tables import stage_table


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn_from, rows: int) -> DataFrame:
    """(doc_id, text, y): labelled documents that may be learned from, at most `rows` of them.

    Ids are taken in hash order, so the sample is spread evenly and the same at every run; a document
    whose labels differ counts as 0; rows without id, text or label are left out. The sample's ids are
    broadcast (16 bytes each, at most `rows`), so the texts are not shuffled; the sample is a table in
    the shared folder.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
              .filter(learn_from).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
              .select(F.col("doc_id").alias("_labelled"), "_y"))
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled"))
    return stage_table(found.select("doc_id", "text", F.col("_y").alias("y")), "labelled")
