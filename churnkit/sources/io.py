"""Readers and writers of the stage files (SRC1, SRC3-SRC8, SNK1-SNK4).

* CSV sources are read with an explicit schema (no inference pass) and the missing-value
  tokens mapped to NULL (Spark keeps text such as 'NA' otherwise).
* Stage handovers are Parquet (columnar, pushdown); the union is partitioned by ``source``.
* Guards give the "run the previous step first" message instead of a stack trace.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnkit.functions.scalar import NULL_TOKENS


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster file system (works for any Hadoop-compatible path)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_members_csv(spark: SparkSession, path: str, schema: StructType, null_tokens=NULL_TOKENS,
                     multi_line: bool = True) -> DataFrame:
    """SRC1/SRC2: header CSV (UTF-8, a BOM header is handled), explicit schema, NULL tokens.

    Columns are taken by name in the order of ``schema``; a missing one raises, and so does a part file
    whose header differs from the others. Quotes inside quoted fields are doubled. With ``multi_line``
    quoted fields may hold line breaks, and each file is one task; switch it off for large files without
    them. Text is NULL only where it equals a token exactly (a blank string stays one); numbers are
    trimmed first, and what doesn't parse is NULL.
    """
    def reader():
        return (spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
                .option("quote", '"').option("escape", '"').option("multiLine", multi_line))

    names = [c.lstrip("\ufeff") for c in reader().csv(path).columns]
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"columns {missing} are not in the header of {path}: {names}")
    raw = reader().option("enforceSchema", False).schema(StructType([StructField(c, StringType(), True) for c in names])).csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            cols.append(F.when(~c.isin(list(null_tokens)), c).alias(f.name))
        else:
            cols.append(F.when(~F.trim(c).isin(list(null_tokens)), F.trim(c)).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def read_stage(spark: SparkSession, path: str, previous_step: str) -> DataFrame:
    """SRC3/SRC8: read a staged Parquet table, or fail with the step that produces it."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"run {previous_step} first; missing: {path}")
    return spark.read.parquet(path)


def resolve_first(spark: SparkSession, candidates: list[str]) -> str:
    """SRC4: the first existing path among ordered candidates."""
    for c in candidates:
        if _exists(spark, c):
            return c
    raise FileNotFoundError(f"none of the inputs exist: {candidates}")


def read_split(df_with_split: DataFrame, part: str, synthetic: DataFrame | None = None) -> DataFrame:
    """SRC6: rows of one part; for 'train' the oversampled rows when ``synthetic`` is given."""
    if part == "train" and synthetic is not None:
        return synthetic
    return df_with_split.filter(F.col("split") == part).drop("split")


def read_json_config(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: a JSON document (plan or best-model configuration) as a DataFrame."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"configuration not found: {path}")
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK1/SNK4: Parquet, overwrite; partitioned (e.g. by ``source``) when asked."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1 (CSV flavour): header, UTF-8, written by the executors in parallel part files."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """SNK2: a small summary document (numbers already computed by Spark) as one JSON file."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def sample_rows(df: DataFrame, n: int = 500, order_by: str = "ID") -> DataFrame:
    """SNK3: the first ``n`` rows in id order (a bounded control sample; the limit is the feature)."""
    return df.orderBy(order_by).limit(n)
