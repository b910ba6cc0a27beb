"""Whitening of embeddings by a covariance that weighs each distinct vector by its multiplicity, or by one.

Rows with the same whole-number vector x are one row of a grouped table, which carries their count. The fit
reads only that table: exact sums, then one centred matrix product per block of rows, the weights on one side,
added up per matrix row. The d x d matrix (the square of the dimension, whatever the number of rows) is
decomposed on the driver. Each distinct vector is whitened once and joined back to its rows; a vector that more
than one in COMMON rows have is looked up from a broadcast table (fewer than COMMON rows by that very count),
the others meet their rows in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.tables import stage_table

SCALE = 256
#: a vector of more than rows / COMMON rows is broadcast (there are fewer than COMMON such vectors)
COMMON = 512


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """`vectors` plus x (array<bigint>): floor(scale * entry) of each entry.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and rows whose length is
    not the most frequent one (the smallest on ties). A column named x is replaced.
    """
    entry = F.col("`" + column.replace("`", "``") + "`").cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.filter(entry.isNotNull() & finite & (F.size(entry) > 0)).withColumn("x", F.transform(entry, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint")))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    found = lengths.first()
    return kept.filter(F.size("x") == (found["d"] if found else 0))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, copies): the distinct vectors with their counts, as a table in the shared folder."""
    return stage_table(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")


def weighted_sums(table: DataFrame, weight: str) -> tuple[int, list[int]]:
    """(sum of weights, weighted sum of each dimension), exact at any size.

    Tasks add up the upper and lower 24 bits of the entries apart, per block, and Spark adds the blocks as decimals.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
            parts = [((x >> 24) >> 20, 44), ((x >> 24) & 0xFFFFF, 24), (x & 0xFFFFFF, 0)]
            for low, bits in ((w & 0xFFFFF, 0), (w >> 20, 20)):
                if bits and not low.any():
                    continue
                for p, shift in parts:
                    s = (p * low[:, None]).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s)), type=pa.int32()), pa.array(np.full(len(s), shift + bits), type=pa.int32()), pa.array(s)], names=["dim", "bits", "s"])

    rows = table.select("x", F.col(weight).cast("bigint").alias("w"))
    exact = "decimal(38,0)"
    sums = rows.mapInArrow(run, "dim int, bits int, s bigint").groupBy("dim", "bits").agg(F.sum(F.col("s").cast(exact)).alias("s")).collect()
    total: dict[int, int] = {}
    for r in sums:
        total[r["dim"]] = total.get(r["dim"], 0) + (int(r["s"]) << r["bits"])
    n = rows.agg(F.sum(F.col("w").cast(exact))).first()[0]
    return int(n or 0), [total[i] for i in sorted(total)]


def centred_products(table: DataFrame, weight: str, mean: np.ndarray) -> np.ndarray:
    """Sum over the table of weight * (x - mean)(x - mean)': one product per block, added up per matrix row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - mean
                held += x.T @ (x * batch.column(1).to_numpy()[:, None])
        flat = pa.array(held.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean)), type=pa.int32()),
                                          pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(mean)), type=pa.int32()), flat)], names=["i", "row"])

    parts = table.select("x", F.col(weight).cast("bigint").alias("w")).mapInArrow(run, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(mean), len(mean)))
    for i, j, v in summed:
        out[i, j] = v
    return (out + out.T) / 2


def whiten_vectors(vectors: DataFrame, column: str = "embedding", components: int = 4, weight: str = "one", scale: int = SCALE) -> DataFrame:
    """`vectors` plus n (long), deviation (long) and whitened (array of component, whitened, explained, identity_error).

    Entries become whole numbers floor(scale * entry); x is such a vector. The fit list is every distinct x, with
    weight one or, with weight="count", once per row; n is its length and S its sums. Components are the unit
    eigenvectors of its covariance by falling eigenvalue e, up to `components` of them; `whitened` is x - S / n
    along them over sqrt(e), null where e is not above rounding (constant or collinear data), `explained` e over the trace, null where the trace
    is 0. `identity_error` is the largest absolute entry of the covariance of `whitened` over the fit list minus the
    identity, over the components with a value. `deviation` is the sum of (n * x - S)^2 over the dimensions, exact,
    or null where it passes 2^63.

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite entries are left out;
    repeated rows, missing ids and columns of any other name are kept as they are (n, deviation, whitened and x are
    replaced). A table without vectors gives no rows.
    """
    if weight not in ("one", "count"):
        raise ValueError("weight is 'one' or 'count'")
    added = {"x", "n", "deviation", "whitened"}
    schema = "array<struct<component:int,whitened:double,explained:double,identity_error:double>>"
    rows = whole_vectors(vectors.drop(*[c for c in vectors.columns if c.lower() in added and c != column]), column, scale)
    rows = stage_table(rows.drop(*[c for c in (column,) if c.lower() in added - {"x"}]), "whole")
    table = distinct_vectors(rows).withColumn("one", F.lit(1))
    by = "one" if weight == "one" else "copies"
    n, sums = weighted_sums(table, by)
    if not n:
        return rows.drop("x").withColumns({"n": F.lit(0).cast("bigint"), "deviation": F.lit(None).cast("bigint"), "whitened": F.lit(None).cast(schema)})
    mean = np.array([s / n for s in sums])
    values, units = np.linalg.eigh(centred_products(table, by, mean) / n)
    top = np.argsort(-values, kind="stable")[:components]
    e, units, trace = values[top], units[:, top], float(values.sum())
    good = e > max(trace, 0.0) * len(mean) * np.finfo(float).eps
    scaled = units / np.sqrt(np.where(good, e, 1.0))
    wide = [abs(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            if n * int(max(abs(int(x.min(initial=0))), int(x.max(initial=0)))) + max(wide) < (2**62 // len(mean)) ** 0.5:
                deviation = ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]
                deviation = [v if v < 2**63 else None for v in exact]
            y = (x - mean) @ scaled
            flat = [pa.array(y[:, k], mask=np.full(len(y), not good[k])) for k in range(len(top))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deviation, type=pa.int64()), *flat], names=["x", "copies", "deviation", *names])

    names = [f"y{k}" for k in range(len(top))]
    once = stage_table(table.select("x", "copies").mapInArrow(run, "x array<bigint>, copies bigint, deviation bigint, " + ", ".join(f"{y} double" for y in names)), "whitened")
    error = _identity_error(once, [y for y, g in zip(names, good) if g], by)
    listed = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(names[k]).alias("whitened"),
                                F.lit(float(e[k] / trace) if trace > 0 else None).cast("double").alias("explained"),
                                F.lit(error).cast("double").alias("identity_error")) for k in range(len(top))])
    once = once.select("x", "copies", F.lit(n).cast("bigint").alias("n"), "deviation", listed.cast(schema).alias("whitened"))
    return joined_back(rows, once).drop("x")


def _identity_error(once: DataFrame, names: list[str], by: str) -> float | None:
    """Largest absolute entry of the covariance of the columns minus the identity (centred: means first)."""
    if not names:
        return None
    w = F.lit(1.0) if by == "one" else F.col("copies").cast("double")
    first = once.agg(F.sum(w).alias("w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in names]).first()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = once.agg(*[(F.sum(w * (F.col(a) - first[a]) * (F.col(b) - first[b])) / first["w"]).alias(f"{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def joined_back(rows: DataFrame, once: DataFrame) -> DataFrame:
    """Each row with what its vector has in `once` (x, copies, ...), whatever share of the rows one vector holds."""
    least = rows.count() // COMMON
    common = once.filter(F.col("copies") > least).drop("copies")
    rare = once.filter(F.col("copies") <= least).drop("copies")
    heavy = stage_table(common, "common")
    if not heavy.head(1):
        return rows.join(rare, "x")
    known = F.broadcast(heavy.select("x"))
    return (rows.join(F.broadcast(heavy), "x")
            .unionByName(rows.join(known, "x", "left_anti").join(rare, "x")))
