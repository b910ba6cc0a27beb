"""Readers and sinks: explicit-schema CSV with NULL tokens, guarded stage reads, fallbacks."""

import os
import tempfile

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def test_csv_null_tokens_and_schema(spark):
    from churnkit.sources.io import read_members_csv
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    with open(os.path.join(d, "t.csv"), "w", encoding="utf-8-sig") as f:
        f.write("ID,MTREV,CDMOTDEM\n1,10,DV\n2,NA,NA\n3, ,null\n4,7,\n")
    schema = StructType([StructField("ID", IntegerType()), StructField("MTREV", IntegerType()),
                         StructField("CDMOTDEM", StringType())])
    rows = sorted(read_members_csv(spark, d, schema).collect())
    assert [tuple(r) for r in rows] == [(1, 10, "DV"), (2, None, None), (3, None, None), (4, 7, None)]


def test_guarded_reads(spark):
    from churnkit.sources.io import read_stage, resolve_first, write_table
    d = tempfile.mkdtemp(prefix="stage-", dir="/tmp")
    with pytest.raises(FileNotFoundError, match="run the union step first"):
        read_stage(spark, os.path.join(d, "missing"), "the union step")
    write_table(spark.range(3).withColumnRenamed("id", "ID"), os.path.join(d, "t2"))
    assert resolve_first(spark, [os.path.join(d, "t1"), os.path.join(d, "t2")]).endswith("t2")
    assert read_stage(spark, os.path.join(d, "t2"), "x").count() == 3


def test_partitioned_union_sink(spark):
    from churnkit.sources.io import write_table
    d = tempfile.mkdtemp(prefix="sink-", dir="/tmp")
    df = spark.createDataFrame([(1, "table1"), (2, "table2")], "ID int, source string")
    write_table(df, os.path.join(d, "u"), partition_by=["source"])
    assert sorted(os.listdir(os.path.join(d, "u")))[-2:] == ["source=table1", "source=table2"]
    back = spark.read.parquet(os.path.join(d, "u")).filter("source = 'table2'")
    assert [r["ID"] for r in back.collect()] == [2]
