"""Synthetic minority oversampling (F18) with exact k nearest neighbours (J5), and the
before/after summary (A13).

k-NN inside the minority class, exact, without enumerating all pairs:

1. identical feature vectors are collapsed into groups; a row's first neighbours are the
   other rows of its own group (distance 0, smallest ranks first), so a hot duplicate group
   never has to be searched or gathered;
2. a k-d tree is fitted on about ``SAMPLE`` distinct vectors (by hash) on the driver and shipped
   as two arrays; every distinct vector finds its leaf in one pass without a shuffle;
3. a leaf's task cuts it into blocks of its own and searches a block's vectors in the nearest blocks only, so
   the work per vector does not grow with the leaf;
4. the leaves' exact bounding boxes come from one grouped aggregate; a vector's k nearest of its own leaf bound
   its radius, and the boxes within that radius are the leaves it must visit;
5. the vectors meet the members of those leaves in a co-grouped step, block by block again; a leaf with many visitors is
   dealt to several tasks; what is within the radius is ranked. Sample and blocks decide only how the work is cut,
   never the result.

Synthetic rows: for s in 0..S-1 (S = majority - minority), seeded md5 picks the base row,
the neighbour rank and the step lambda in [0, 1); x_new = x + lambda * (x_nn - x); integer
features are truncated back to integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.ranks import dense_row_ids
from churnkit.session import materialize

K_NEIGHBOURS = 5
SEED = 42
BLOCK_ROWS = 256    # distinct vectors of a block inside a leaf, at most
LEAF_BLOCKS = 16    # blocks of a leaf, on average
SAMPLE = 65_536     # distinct vectors the tree's cuts are fitted on
SAMPLED = 16        # of them in a leaf, at least
VISITORS = 20_000   # vectors that one task compares with a leaf
NEAR = 4            # blocks looked through together


def _hex_int(h: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(h, start, length), 16, 10).cast("long")


def fit_tree(vectors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, cut) of the nodes 1 .. 2^depth - 1 of a k-d tree: the widest coordinate at its median.

    A vector goes right (2 * node + 1) if its coordinate is above the cut; a node whose vectors are all alike
    sends everything left (coordinate 0, infinite cut).
    """
    which, cut = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
    parts = {1: vectors}
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        if len(own):
            low, high = own.min(axis=0), own.max(axis=0)
            i = int(np.argmax(high - low))
            if high[i] > low[i]:
                column = own[:, i]
                m = np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2]
                which[node], cut[node] = i, m if m < high[i] else column[column < m].max()
        right = own[:, which[node]] > cut[node]
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return which, cut


def leaf_of(vectors: np.ndarray, which: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Leaf (node number at the tree's depth) of each vector."""
    node = np.ones(len(vectors), dtype=np.int64)
    at = np.arange(len(vectors))
    for _ in range(len(which).bit_length() - 1):
        node = 2 * node + (vectors[at, which[node]] > cut[node])
    return node


def _matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    flat = table.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def blocks_of(vectors: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of the blocks: halved at the median of the widest coordinate until they have at most ``rows`` rows."""
    done, left = [], [np.arange(len(vectors))] if len(vectors) else []
    while left:
        at = left.pop()
        own = vectors[at]
        low, high = own.min(axis=0), own.max(axis=0)
        i = int(np.argmax(np.subtract(high, low, out=np.zeros(len(low)), where=high > low))) if len(low) else 0
        if len(at) <= rows or not len(low) or not high[i] > low[i]:
            done.append(at)
            continue
        column = own[:, i]
        m = np.partition(column, (len(column) - 1) // 2)[(len(column) - 1) // 2]
        right = column > (m if m < high[i] else column[column < m].max())
        left += [at[right], at[~right]]
    return done


def _ends(vectors: np.ndarray, blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of each block."""
    shape = (len(blocks), vectors.shape[1])
    return np.array([vectors[b].min(axis=0) for b in blocks]).reshape(shape), np.array([vectors[b].max(axis=0) for b in blocks]).reshape(shape)


def nearest(x: np.ndarray, y: np.ndarray, k: int, block: int, within: np.ndarray | None = None, itself: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of x: (its rows, row of y, squared distance) of the k nearest rows of y, ties in y's order; places without one hold ``len(y)`` and infinity.

    A block of x meets the blocks of y nearest first, until none is within reach. Pairs are screened by products of matrices (with
    more than their rounding error as a margin); the squares of what is left are added coordinate by coordinate,
    so a distance is the same number wherever it is computed. ``within``: only distances up to this; ``itself``: y is x, and a row is not its own neighbour.
    """
    y_blocks = blocks_of(y, block)
    low, high = _ends(y, y_blocks)
    with np.errstate(all="ignore"):     # infinite coordinates have no finite distance; what cannot be screened is computed
        middle = y.mean(axis=0) if len(y) else np.zeros(y.shape[1])
        xm, ym = x - middle, y - middle
        xx, yy = (xm * xm).sum(axis=1), (ym * ym).sum(axis=1)
        left = np.column_stack([xm, xx, np.ones(len(x))])
        right = np.column_stack([-2.0 * ym, np.ones(len(y)), yy]).T
        error = 16 * (x.shape[1] + 4) * np.finfo(float).eps
        for at in y_blocks if itself else blocks_of(x, block):
            part = x[at]
            best, dist = np.full((len(at), k), len(y)), np.full((len(at), k), np.inf)
            reach = np.full(len(at), np.inf) if within is None else within[at]
            gaps = _gap(part.min(axis=0)[None], part.max(axis=0)[None], low, high)[0]
            order, taken, step = np.argsort(gaps, kind="stable"), 0, 1
            while taken < len(order) and gaps[order[taken]] <= reach.max():
                some, taken, step = order[taken:taken + step], taken + step, NEAR
                hit = _gap(part, part, low[some], high[some]) <= reach[:, None]
                mine, theirs = np.flatnonzero(hit.any(axis=1)), some[hit.any(axis=0)]
                if not len(mine):
                    continue
                rows = np.concatenate([y_blocks[b] for b in theirs])
                about = left[at[mine]] @ right[:, rows]
                if itself:
                    about[at[mine][:, None] == rows[None, :]] = np.inf
                margin = error * (xx[at[mine]] + yy[rows].max())
                bound = reach[mine]
                if len(rows) > k:
                    bound = np.minimum(bound, np.partition(about, k - 1, axis=1)[:, k - 1] + margin)
                i, j = np.nonzero(~(about > (bound + margin)[:, None]))
                i, j = mine[i], rows[j]
                d = np.zeros(len(i))
                for c in range(x.shape[1]):
                    e = part[i, c] - y[j, c]
                    d += e * e
                keep = np.isfinite(d) & (d <= reach[i])
                if itself:
                    keep &= at[i] != j
                i, j, d = i[keep], j[keep], d[keep]
                if not len(i):
                    continue
                old = np.flatnonzero(np.isin(np.arange(len(at)), i))
                i = np.concatenate([i, np.repeat(old, k)])
                j, d = np.concatenate([j, best[old].ravel()]), np.concatenate([d, dist[old].ravel()])
                sort = np.lexsort((j, d, i))
                i, j, d = i[sort], j[sort], d[sort]
                first = np.r_[True, i[1:] != i[:-1]]
                rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                i, j, d, rank = (a[rank < k] for a in (i, j, d, rank))
                best[i, rank], dist[i, rank] = j, d
                reach = np.minimum(reach, dist[:, k - 1])
            yield at, best, dist


def _group_knn(groups: DataFrame, k: int, block: int, leaf_blocks: int = LEAF_BLOCKS) -> DataFrame:
    """Exact k nearest distinct vectors: ``(gid, nid, d2)`` for the k nearest other groups.

    ``groups`` holds ``gid`` (long) and ``v`` (array<double>, all of one length, distinct); vectors with missing
    or NaN coordinates have no distance and no neighbours. Beyond SAMPLE / SAMPLED leaves their size grows with the
    table, not the work per vector: a leaf is searched block by block.
    """
    groups = groups.select("gid", "v").filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c)))
    n = groups.count()
    leaves_wanted = min(n / (leaf_blocks * max(block, k + 1)), SAMPLE / SAMPLED)
    depth = max(0, int(np.ceil(np.log2(max(1, leaves_wanted)))))
    some = F.pmod(F.xxhash64("gid"), F.lit(1 << 32)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 32))
    which, cut = fit_tree(_matrix(groups.filter(some).select("v").toArrow()), depth) if depth else (np.zeros(1, dtype=np.int64), np.zeros(1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(_matrix(pa.Table.from_batches([batch])), which, cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["gid", "v", "leaf"])

    g = materialize(groups.mapInArrow(assign, "gid long, v array<double>, leaf long"))
    dim = len(g.first()["v"]) if n else 0
    ends = [f(F.element_at("v", i + 1)).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dim)]
    boxes = g.groupBy("leaf").agg(*ends).orderBy("leaf").collect()      # a row per leaf
    leaves = np.array([r["leaf"] for r in boxes], dtype=np.int64)
    low, high = (np.array([[r[f"{name}{i}"] for i in range(dim)] for r in boxes]).reshape(len(boxes), dim) for name in ("lo", "hi"))

    def inside(table: pa.Table) -> pa.Table:
        """Per vector of a leaf: its k nearest inside (``near``) and the other leaves within reach (``visits``)."""
        table = table.sort_by("gid")
        x, gid = _matrix(table), table.column("gid").to_numpy()
        own = int(np.searchsorted(leaves, table.column("leaf")[0].as_py()))
        rows, near, far, visits = [], [], [], []
        for at, j, d in nearest(x, x, k, block, itself=True):
            part, r2 = x[at], d[:, k - 1]
            wide = _gap(part.min(axis=0)[None], part.max(axis=0)[None], low, high)[0] <= r2.max()
            wide[own] = False
            reached = np.flatnonzero(wide)
            visits += [leaves[reached[row]] for row in _gap(part, part, low[reached], high[reached]) <= r2[:, None]]
            rows.append(at)
            near.append(j)
            far.append(d)
        rows, j, d = np.concatenate(rows), np.concatenate(near), np.concatenate(far)
        found = j < len(gid)
        pairs = pa.StructArray.from_arrays([pa.array(gid[j[found]]), pa.array(d[found])], names=["nid", "d2"])
        return pa.table({"gid": pa.array(gid[rows]), "v": table.column("v").take(pa.array(rows)), "r2": pa.array(d[:, k - 1]),
                         "visits": _lists([len(r) for r in visits], pa.array(np.concatenate(visits))),
                         "near": _lists(found.sum(axis=1), pairs)})

    found = materialize(g.groupBy("leaf").applyInArrow(inside, "gid long, v array<double>, r2 double, visits array<long>, near array<struct<nid:long,d2:double>>"))
    own = found.select("gid", F.explode("near").alias("e")).select("gid", "e.nid", "e.d2")
    visits = found.select("gid", "v", "r2", F.explode("visits").alias("leaf"))
    shares = materialize(visits.groupBy("leaf").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("shares")))
    guests = visits.join(F.broadcast(shares), "leaf").withColumn("share", F.pmod(F.xxhash64("gid"), F.col("shares")).cast("int")).drop("shares")   # a row per leaf
    hosts = g.join(F.broadcast(shares), "leaf").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def visited(guest: pa.Table, host: pa.Table) -> pa.Table:
        host = host.sort_by("gid")
        gid, nid, d2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if guest.num_rows and host.num_rows:
            ours, theirs = guest.column("gid").to_numpy(), host.column("gid").to_numpy()
            for at, j, d in nearest(_matrix(guest), _matrix(host), k, block, within=guest.column("r2").to_numpy()):
                met = j < len(theirs)
                gid.append(np.repeat(ours[at], met.sum(axis=1)))
                nid.append(theirs[j[met]])
                d2.append(d[met])
        return pa.table({"gid": np.concatenate(gid), "nid": np.concatenate(nid), "d2": np.concatenate(d2)})

    more = guests.groupBy("leaf", "share").cogroup(hosts.groupBy("leaf", "share")).applyInArrow(visited, "gid long, nid long, d2 double")
    w = Window.partitionBy("gid").orderBy("d2", "nid")
    return own.unionByName(more).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).drop("rk")


def _lists(sizes, values: pa.Array) -> pa.Array:
    """``values`` cut into lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _gap(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Squared distance of boxes (or points: low = high) to boxes."""
    out = np.zeros((len(low), len(box_low)))
    for i in range(low.shape[1]):
        e = np.maximum(np.maximum(box_low[None, :, i] - high[:, i, None], low[:, i, None] - box_high[None, :, i]), 0.0)
        out += e * e
    return out


def minority_neighbours(rows: DataFrame, features: list[str], k: int = K_NEIGHBOURS, block: int = BLOCK_ROWS,
                        n_buckets: int | None = None, leaf_blocks: int = LEAF_BLOCKS) -> DataFrame:
    """``(ID, j, nbr_id)`` for j = 0..k-1, the k nearest other rows (distance, then group
    order, then id rank). ``rows`` holds ``ID`` and the feature columns."""
    r = rows.select("ID", F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    # groups and ranks feed several branches: each is written once
    groups = materialize(r.groupBy("v").agg(F.count("*").alias("g"), F.min("ID").alias("gid")))
    r = r.join(groups, "v").drop("v")
    # rank of each row inside its duplicate group (parallel; buckets on the global id order)
    r = materialize(dense_row_ids(r, "ID", out_col="rnk", group_cols=["gid"], global_buckets=True, n_buckets=n_buckets))
    firsts = r.filter(F.col("rnk") <= k + 1).select(F.col("gid").alias("fgid"), F.col("rnk").alias("frnk"),
                                                     F.col("ID").alias("nbr_id"))
    # (a) duplicates: the j-th other row of the own group
    j = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")
    dup = r.select("ID", "gid", "g", "rnk", j)
    dup = dup.withColumn("t", F.col("j") + 1 + (F.col("j") + 1 >= F.col("rnk")).cast("int")).filter(F.col("t") <= F.col("g"))
    dup = dup.join(firsts, (F.col("gid") == F.col("fgid")) & (F.col("t") == F.col("frnk"))).select("ID", "j", "nbr_id")
    # (b) rows of the nearest other groups, for rows whose group has fewer than k other rows
    need = r.filter(F.col("g") - 1 < k).select("ID", "gid", (F.lit(k) - (F.col("g") - 1)).alias("extra"))
    small = groups.filter(F.col("g") - 1 < k).select("gid", "v")
    if k > 0:
        near = _group_knn(groups, k, block, leaf_blocks).join(small.select("gid"), "gid")
        cand = near.join(firsts.filter(F.col("frnk") <= k).withColumnRenamed("fgid", "nid")
                         .withColumnRenamed("frnk", "rnk"), "nid")
        ext = need.join(cand, "gid")
        w = Window.partitionBy("ID").orderBy("d2", "nid", "rnk")   # <= k * k candidates per row
        ext = ext.withColumn("o", F.row_number().over(w)).filter(F.col("o") <= F.col("extra"))
        base_cnt = F.least(F.col("g") - 1, F.lit(k))
        ext = ext.join(r.select("ID", "g"), "ID").select("ID", (base_cnt + F.col("o") - 1).cast("int").alias("j"), "nbr_id")
        return dup.unionByName(ext)
    return dup


def smote(train: DataFrame, features: list[str], target: str = "cible_churn", k: int = K_NEIGHBOURS,
          seed: int = SEED, int_features: list[str] | None = None) -> DataFrame:
    """original training rows (``is_synthetic`` false) + synthetic minority rows until the
    classes are balanced. Synthetic rows get the negative ids -1, -2, ... (deterministic)."""
    counts = train.groupBy(target).agg(F.count("*").alias("n"))
    c = {row[target]: row["n"] for row in counts.collect()}      # one row per class
    orig = train.select("ID", *features, target, F.lit(False).alias("is_synthetic"))
    if len(c) < 2 or len(set(c.values())) == 1:
        return orig
    minority = min(c, key=lambda key: (c[key], key))
    n_syn = max(c.values()) - c[minority]
    mino = train.filter(F.col(target) == minority).select("ID", *features)
    nb = materialize(minority_neighbours(mino, features, k))      # counted and joined
    n_nb = nb.groupBy("ID").agg(F.count("*").alias("k_avail"))
    pos = dense_row_ids(mino.select("ID"), "ID", out_col="p")
    m = c[minority]
    h = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}")))
    syn = train.sparkSession.range(n_syn).select(
        (-F.col("id") - 1).alias("sid"),
        (F.pmod(_hex_int(h, 1, 12), F.lit(m)) + 1).alias("p"), _hex_int(h, 13, 8).alias("jr"),
        (_hex_int(h, 21, 8) / F.lit(float(16 ** 8))).alias("lam"))
    syn = syn.join(pos, "p").join(n_nb, "ID").withColumn("j", F.pmod(F.col("jr"), F.col("k_avail")).cast("int"))
    syn = syn.join(nb, ["ID", "j"]).select("sid", F.col("ID").alias("base_id"), "nbr_id", "lam")
    xb = mino.select(F.col("ID").alias("base_id"), *[F.col(f).alias(f"b_{f}") for f in features])
    xn = mino.select(F.col("ID").alias("nbr_id"), *[F.col(f).alias(f"n_{f}") for f in features])
    s = syn.join(xb, "base_id").join(xn, "nbr_id")
    ints = set(int_features if int_features is not None else
               [f for f in features if train.schema[f].dataType.typeName() in ("integer", "long", "short", "byte")])
    cols = []
    for f in features:
        x = F.col(f"b_{f}").cast("double") + F.col("lam") * (F.col(f"n_{f}").cast("double") - F.col(f"b_{f}").cast("double"))
        cols.append((x.cast(train.schema[f].dataType) if f in ints else x).alias(f))
    synthetic = s.select(F.col("sid").alias("ID"), *cols, F.lit(minority).cast(train.schema[target].dataType).alias(target),
                         F.lit(True).alias("is_synthetic"))
    return orig.unionByName(synthetic)


def smote_summary(train: DataFrame, balanced: DataFrame, target: str = "cible_churn") -> DataFrame:
    """Class counts before and after oversampling, and the synthetic row count."""
    before = train.groupBy(target).agg(F.count("*").alias("n_before"))
    after = balanced.groupBy(target).agg(F.count("*").alias("n_after"),
                                         F.count_if(F.col("is_synthetic")).alias("n_synthetic"))
    return before.join(after, target, "full")

