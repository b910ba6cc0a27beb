"""Shared-folder tables and Arrow streaming helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from churnkit.session import checkpoint_dir


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as Parquet into the cluster's shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the files), keeps columnar pruning, and is shared by
    all branches that use the table.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, added: str) -> tuple[DataFrame, list[str], StructType]:
    """(rows, their columns, schema with the columns of the DDL `added` at the end).

    Columns of `df` whose names clash with added ones (in any case) are left out.
    """
    new = StructType.fromDDL(added)
    taken = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    rows = df.select([F.col("`" + c.replace("`", "``") + "`") for c in kept])
    return rows, kept, StructType(rows.schema.fields + new.fields)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def binary_array(arrays: Iterable[np.ndarray]) -> pa.Array:
    """One binary value (the raw little-endian memory) per numpy array."""
    return pa.array([a.tobytes() for a in arrays], type=pa.binary())


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys of a sorted Arrow stream, one table per key.

    Only the rows of the current group are held; the caller's keys keep groups bounded.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            cut |= c[1:] != c[:-1]
        stops = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
