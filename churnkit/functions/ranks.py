"""Distributed ranking: average ranks with ties (W1) and dense row ids.

A plain ``row_number().over(Window.orderBy(v))`` moves every row into one task. Both
helpers here cut the ordered key space into equi-depth *buckets* (approximate quantiles
per group, a bounded array of ``n_buckets`` values), so that

* the ordered window runs per ``(group, bucket)`` - many parallel tasks, each ~1/n_buckets
  of the group's distinct keys;
* only the tiny bucket-count table (``groups x n_buckets`` rows, a proven bound) is
  ordered as a whole, to get each bucket's offset;
* the bucket index is a function of the value, so equal values never straddle buckets and
  the result is exact (approximation only affects balance, never correctness).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from churnkit.session import materialize

ROWS_PER_BUCKET = 200_000                # rows one ordered window may hold
SMALL_SPLITS = 1_000_000                 # split values that are broadcast
GROUPS = 2_000                           # groups whose quantiles are narrowed together
BINS = 1_024                             # slices of an interval
FEW = 2_000                              # rows of an interval whose values are read
PASSES = 12
BUCKETS_CONF = "churnkit.rank.buckets"   # session setting: overrides the measured bucket count


def _buckets(df: DataFrame, n_buckets: int | None) -> int:
    """Bucket count: as asked, as set in the session, or measured (rows / ROWS_PER_BUCKET)."""
    if n_buckets is not None:
        return n_buckets
    asked = df.sparkSession.conf.get(BUCKETS_CONF, None)
    return int(asked) if asked else max(1, -(-df.count() // ROWS_PER_BUCKET))


def _same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on ``cols`` where NULL equals NULL; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    if small:
        renamed = F.broadcast(renamed)
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return (left.join(renamed, on, how) if cols else left.crossJoin(renamed)).drop(*[f"_k_{c}" for c in cols])


def _below(sorted_values: str, size: int, v: Column) -> Column:
    """How many entries of a sorted array of at most ``size`` are less than ``v``, in two steps of about sqrt(size)."""
    step = math.isqrt(size) + 1

    def less(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s < v))

    # whole blocks of `step` entries whose last one is less; the block after them is looked through
    blocks = F.size(F.filter(F.sequence(F.lit(step), F.lit(step * step), F.lit(step)), lambda i: F.get(sorted_values, i - 1) < v)) * step
    return (blocks + less(F.slice(sorted_values, blocks + 1, F.lit(step)))).cast("int")


def _attach_buckets(df: DataFrame, value_col: str, group_cols: list[str], n_buckets: int,
                    accuracy: int = 10000, out: str = "_b") -> DataFrame:
    """Adds ``_b``: equi-depth bucket of ``value_col`` within ``group_cols``.

    A value that is itself a split has a bucket of its own (odd number), so a hot value shares its
    window with no other; NULL values (and groups without any value) are in bucket 0.

    The splits are written and counted first: up to ``SMALL_SPLITS`` of them are broadcast, so that the rows of
    a group are not brought together for the join (the planner would, as it takes few groups for too few partitions).
    """
    accuracy = max(accuracy, 10 * n_buckets)
    if n_buckets <= 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = materialize(df.groupBy(*group_cols).agg(
        F.array_distinct(F.percentile_approx(F.col(value_col).cast("double"), probs, accuracy)).alias("_splits")))
    small = splits.agg(F.coalesce(F.sum(F.greatest(F.size("_splits"), F.lit(1))), F.lit(0))).first()[0] <= SMALL_SPLITS
    joined = _same(df, splits, group_cols, "left", small=small)
    v = F.col(value_col).cast("double")
    joined = joined.withColumn("_below", _below("_splits", n_buckets - 1, v))
    bucket = 2 * F.col("_below") + F.coalesce(F.get("_splits", F.col("_below")) == v, F.lit(False)).cast("int")
    return joined.withColumn(out, F.when(v.isNull() | F.col("_splits").isNull(), F.lit(0)).otherwise(bucket)).drop("_splits", "_below")


def _windowed(df: DataFrame, keys: list[str], n_buckets: int) -> DataFrame:
    """Rows dealt by the keys of an ordered window, over as many partitions as there are buckets if those are more."""
    wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_buckets)
    return df.repartition(wanted, *keys)


def _with_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the offset of their bucket; up to ``SMALL_SPLITS`` offsets are broadcast, so that rows stay where the window left them."""
    offsets = materialize(offsets)
    return _same(rows, offsets, keys, small=offsets.count() <= SMALL_SPLITS)


def value_positions(df: DataFrame, value_col: str, group_cols=(), weight_col: str | None = None,
                    n_buckets: int | None = None) -> DataFrame:
    """Distinct non-null values per group with their multiplicity and sorted position.

    Output: ``*group_cols, value_col, n, before`` where ``before`` = number of rows (or
    summed weight) of the group holding a strictly smaller value. Rows holding the value
    occupy 1-based positions ``before + 1 .. before + n``.
    """
    g = list(group_cols)
    base = df.filter(F.col(value_col).isNotNull())
    w = F.col(weight_col) if weight_col else F.lit(1)
    counts = base.groupBy(*g, value_col).agg(F.sum(w).cast("long").alias("n"))
    # the distinct-value table feeds the count, the splits, the window, the bucket totals and the
    # final join: write it once so the source is scanned once, not once per branch
    counts = materialize(counts)
    n_buckets = _buckets(counts, n_buckets)
    if n_buckets <= 1:
        upto = Window.partitionBy(*g).orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.select(*g, value_col, "n", (F.sum("n").over(upto) - F.col("n")).cast("long").alias("before"))
    counts = materialize(_attach_buckets(counts, value_col, g, n_buckets))
    within = Window.partitionBy(*g, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = _windowed(counts, [*g, "_b"], n_buckets).withColumn("_cum", F.sum("n").over(within))
    per_bucket = counts.groupBy(*g, "_b").agg(F.sum("n").alias("_bn"))
    # per group at most n_buckets rows: the only ordered pass over a whole group is on this table
    prior = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_off", F.coalesce(F.sum("_bn").over(prior), F.lit(0))).drop("_bn")
    pos = _with_offsets(counts, offsets, g + ["_b"])
    return pos.select(*g, value_col, "n", (F.col("_off") + F.col("_cum") - F.col("n")).cast("long").alias("before"))


def average_rank_table(df: DataFrame, value_col: str, group_cols=(), weight_col: str | None = None,
                       n_buckets: int | None = None, out_col: str = "rank") -> DataFrame:
    """Distinct values of ``value_col`` per group with their average (tie-aware, 1-based) rank.

    Output columns: ``*group_cols, value_col, n, out_col``. NULL values are not ranked.
    """
    pos = value_positions(df, value_col, group_cols, weight_col, n_buckets)
    rank = F.col("before") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    return pos.select(*group_cols, value_col, "n", rank.cast("double").alias(out_col))


def rank_sums(cells: DataFrame, value_col: str, n: str, weight: str, group_cols=(), n_buckets: int | None = None) -> DataFrame:
    """Per group and bucket of values: rows (``n``), ``weight``, and ``rsum``, the weights times the average ranks within the bucket.

    ``cells``: one row per group and non-null value with its number of rows and weight, stored (it is read more than once).
    Buckets (``_b``) are in the order of their values.
    """
    g = list(group_cols)
    n_buckets = _buckets(cells, n_buckets)
    dealt = _attach_buckets(cells, value_col, g, n_buckets)
    if n_buckets > 1:
        dealt = _windowed(dealt, [*g, "_b"], n_buckets)
    within = Window.partitionBy(*g, "_b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = (F.sum(n).over(within) - F.col(n)) + (F.col(n) + F.lit(1)) / F.lit(2.0)
    return dealt.withColumn("_rank", rank).groupBy(*g, "_b").agg(
        F.sum(F.col("_rank") * F.col(weight)).alias("rsum"), F.sum(n).alias(n), F.sum(weight).alias(weight))


def exact_quantiles(df: DataFrame, value_col: str, probs: dict[str, float], group_cols=(),
                    n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (same definition as pandas / ``quantile_cont``).

    One row per group with one column per entry of ``probs``; groups without values are left out. All groups and
    positions are narrowed together: a pass counts the rows of ``BINS`` equal slices of every interval that still holds a
    wanted order statistic (combined before the shuffle, so a pass moves intervals x slices rows), and the slice
    that holds it is the next interval, from its least to its greatest value. Intervals of one value are
    done, those of at most ``FEW`` rows are read. No distinct values are shuffled and no task holds a group.

    More than ``GROUPS`` groups, values without a scale (NaN, infinite) and intervals that do not shrink in ``PASSES``
    passes take the way over the table of distinct values instead.
    """
    g = list(group_cols)
    base = df.select(*g, F.col(value_col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    odd = F.isnan("_v") | (F.abs("_v") == float("inf"))
    found = base.groupBy(*g).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count_if(odd).alias("odd")).limit(GROUPS + 1).collect()
    found = [r for r in found if r["n"]]
    values = None if len(found) > GROUPS or any(r["odd"] for r in found) or n_buckets is not None else _order_statistics(base, found, probs, g)
    if values is None:
        return _quantiles_by_position(df, value_col, probs, g, n_buckets)
    schema = StructType([df.schema[c] for c in g] + [StructField(q, DoubleType()) for q in probs])
    rows = []
    for i, r in enumerate(found):
        row = [r[c] for c in g]
        for p in probs.values():
            low, high, part = _around(r["n"], p)
            row.append(values[i, low] + part * (values[i, high] - values[i, low]))
        rows.append(tuple(row))
    if not g and not rows:
        rows = [(None,) * len(probs)]
    return df.sparkSession.createDataFrame(rows, schema)


def _around(n: int, p: float) -> tuple[int, int, float]:
    """(1-based order statistics around the position of a quantile, share of the upper one)."""
    h = (n - 1) * float(p)
    low = math.floor(h)
    return low + 1, min(low + 2, n), h - low


def _order_statistics(base: DataFrame, groups: list, probs: dict[str, float], g: list[str]) -> dict[tuple[int, int], float] | None:
    """(group number, order statistic) -> value, or None where the intervals do not shrink."""
    spark = base.sparkSession
    done: dict[tuple[int, int], float] = {}
    open_ = []                                  # (group, lo, hi, rows before, rows inside, wanted order statistics)
    for i, r in enumerate(groups):
        wanted = sorted({k for p in probs.values() for k in _around(r["n"], p)[:2]})
        open_.append((i, r["lo"], r["hi"], 0, r["n"], wanted))
    keys = StructType([base.schema[c] for c in g] + [StructField("_i", IntegerType()), StructField("_lo", DoubleType()), StructField("_hi", DoubleType()), StructField("_few", BooleanType())])
    for _ in range(PASSES):
        left = []
        for iv in open_:
            if iv[1] == iv[2]:
                done |= {(iv[0], k): iv[1] for k in iv[5]}
            else:
                left.append(iv)
        if not left:
            return done
        table = spark.createDataFrame([tuple(groups[iv[0]][c] for c in g) + (i, iv[1], iv[2], iv[4] <= FEW) for i, iv in enumerate(left)], keys)
        rows = _same(base, table, g, small=True).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))   # at most GROUPS x positions intervals
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        slice_ = F.when(F.col("_few"), F.col("_v")).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double"))
        counted = (rows.select("_i", slice_.alias("_s"), "_v").groupBy("_i", "_s")
                   .agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect())
        slices: dict[int, list] = {}
        for r in counted:
            slices.setdefault(r["_i"], []).append((r["_s"], r["n"], r["lo"], r["hi"]))
        open_ = []
        for i, iv in enumerate(left):
            before, wanted = iv[3], list(iv[5])
            for _, n, lo, hi in sorted(slices.get(i, [])):
                here = [k for k in wanted if before < k <= before + n]
                if here:
                    open_.append((iv[0], lo, hi, before, n, here))
                before += n
    return done if not open_ else None


def _quantiles_by_position(df: DataFrame, value_col: str, probs: dict[str, float], group_cols=(),
                    n_buckets: int | None = None) -> DataFrame:
    """Quantiles from the distinct-value position table, for any number of groups.

    One row per group with one column per entry of ``probs``. Only the two order statistics
    around each requested position are looked up in the distinct-value position table, so
    no task ever holds a whole group (unlike the ``percentile`` aggregate, whose final merge
    keeps every distinct value of a group in one task).
    """
    g = list(group_cols)
    pos = value_positions(df, value_col, g, n_buckets=n_buckets)
    totals = pos.groupBy(*g).agg(F.sum("n").alias("_N"))
    targets = F.array(*[F.struct(F.lit(k).alias("_q"), F.lit(float(p)).alias("_p")) for k, p in probs.items()])
    t = totals.select(*g, "_N", F.explode(targets).alias("_t")).select(*g, "_N", "_t._q", "_t._p")
    h = (F.col("_N") - 1) * F.col("_p")
    t = t.select(*g, "_q", (F.floor(h) + 1).alias("_klo"), (h - F.floor(h)).alias("_frac"),
                 F.least(F.floor(h) + 2, F.col("_N")).alias("_khi"))
    # targets: groups x len(probs) rows; without groups a handful, else the planner sizes the join
    j = _same(pos, t, g, small=not g)
    lo_hit = (F.col("before") < F.col("_klo")) & (F.col("_klo") <= F.col("before") + F.col("n"))
    hi_hit = (F.col("before") < F.col("_khi")) & (F.col("_khi") <= F.col("before") + F.col("n"))
    v = F.col(value_col).cast("double")
    picked = (j.filter(lo_hit | hi_hit).groupBy(*g, "_q")
              .agg(F.max(F.when(lo_hit, v)).alias("_lo"), F.max(F.when(hi_hit, v)).alias("_hi"),
                   F.first("_frac").alias("_frac")))
    picked = picked.withColumn("_v", F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo")))
    return picked.groupBy(*g).pivot("_q", list(probs)).agg(F.first("_v"))


def with_average_rank(df: DataFrame, value_col: str, group_cols=(), out_col: str = "rank",
                      n_buckets: int | None = None) -> DataFrame:
    """Row-level average rank (W1): joins the distinct-value rank table back on the value."""
    g = list(group_cols)
    table = average_rank_table(df, value_col, g, n_buckets=n_buckets, out_col=out_col).drop("n")
    return df.join(table, g + [value_col], "left")


def dense_row_ids(df: DataFrame, key_col: str, group_order: list[tuple[str, list]] | None = None,
                  out_col: str = "ID", n_buckets: int | None = None, group_cols=(), tie_cols=(),
                  global_buckets: bool = False) -> DataFrame:
    """Dense ids ``1..n`` following ``(group order, key_col, tie_cols)`` (W2), computed in parallel.

    ``group_order`` = ``[(column, [value, ...])]`` fixes the order of a low-cardinality group
    column (e.g. ``source`` with table1 first); ids run across those groups. With
    ``group_cols`` the numbering restarts at 1 inside each group instead. Rows are bucketed
    on ``key_col`` (monotone in the full order); rows that share a hot key are bucketed again on the
    first of ``tie_cols``, which order rows that share a key value. NULL keys come first. ``global_buckets`` computes one set of bucket splits for all groups
    (use it when ``group_cols`` has many values: the per-group split table would not be small).
    """
    g: list[str] = []
    d = df
    if group_order:
        for col, values in group_order:
            rank_expr = F.lit(len(values))
            for i, v in reversed(list(enumerate(values))):
                rank_expr = F.when(F.col(col) == F.lit(v), F.lit(i)).otherwise(rank_expr)
            d = d.withColumn(f"_g_{col}", rank_expr)
            g.append(f"_g_{col}")
    part = list(group_cols)
    n_buckets = _buckets(d, n_buckets)
    if n_buckets <= 1:
        whole = Window.partitionBy(*part).orderBy(*g, key_col, *tie_cols)
        return d.withColumn(out_col, F.row_number().over(whole).cast("long")).drop(*g)
    d = _attach_buckets(d, key_col, [] if global_buckets else part + g, n_buckets)
    # rows that share a hot key are cut again by the first tie column
    if tie_cols:
        d = d.withColumn("_tie", F.when(F.col("_b") % 2 == 1, F.col(tie_cols[0]).try_cast("double")))
        d = _attach_buckets(d, "_tie", part + g + ["_b"], n_buckets, out="_b2").drop("_tie")
    else:
        d = d.withColumn("_b2", F.lit(0))
    # rows with their bucket feed the numbering window, the bucket counts and the final join: written once
    d = materialize(d)
    within = Window.partitionBy(*part, *g, "_b", "_b2").orderBy(key_col, *tie_cols)
    numbered = _windowed(d, [*part, *g, "_b", "_b2"], n_buckets).withColumn("_rn", F.row_number().over(within))
    per_bucket = d.groupBy(*part, *g, "_b", "_b2").agg(F.count("*").alias("_bn"))
    # groups x buckets rows
    before = Window.partitionBy(*part).orderBy(*g, "_b", "_b2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0))).drop("_bn")
    out = _with_offsets(numbered, offsets, part + g + ["_b", "_b2"])
    out = out.withColumn(out_col, (F.col("_off") + F.col("_rn")).cast("long"))
    return out.drop("_rn", "_off", "_b", "_b2", *g)
