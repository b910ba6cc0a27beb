"""N-gram Jaccard join: exact links between documents whose 5-word shingle sets are alike.

Method: count-vector R-tree. The shingles of a document are hashed into groups; the counts per
group are a point. Points are bulk-loaded into an R-tree; the sum over the groups of the smaller
coordinate (of a point, or of a node's upper corner) bounds the overlap of two sets from above, so
whole subtrees fall away and only surviving pairs are verified on their full shingle sets.

Around the tree, Spark does what keeps it distributed and exact:

1.  shingles that many documents share are found by partial counts and put last in one global
    token order (any order is correct; this one keeps passages out of the prefixes);
2.  every document sends the prefix of its set in that order (|x| - ceil(t |x|) + 1 tokens). Two
    linked sets share a prefix token, so they meet in one token run. Runs are read as a sorted
    stream in constant memory; each run names its smallest member as the cell of its members;
3.  cells with more shingles than a block are split by hash into blocks, and pairs of blocks are
    the work units, so one group of near copies is spread over many tasks;
4.  units first get only the points: members without a partner that the tree lets through fall
    away. The others meet again with their full sets; each unit verifies what survives the tree and
    returns a spanning forest of the links it found (never all pairs); the components of those edges
    are computed with DataFrame operations.

Equal sets are one node throughout, so exact copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm.components import connected_components
from churnkit.llm.tables import as_bytes, binary_array, extended, sorted_groups, stage_table
from churnkit.llm.wordhash import MASK, mix64, shingle_sets

#: shingles put last in the token order: at most so many (8 bytes each are broadcast)
HOT_TOKENS = 1 << 17
#: a shingle counts as shared by many from so many documents
HOT_DOCS = 16
#: documents ids broadcast at most (8 bytes each); beyond it the planner joins by shuffle
BROADCAST_IDS = 1 << 20
#: shingles of one block of a cell, when full sets are shipped and when points are
BLOCK_SHINGLES, BLOCK_POINTS = 1 << 20, 1 << 23
#: coordinates of a point: at least so many, else an eighth of the shingles or more; entries of an R-tree leaf
GROUPS, LEAF = 64, 16


def _needed(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b with Jaccard >= num / den."""
    total = num * (np.asarray(a, dtype=np.int64) + b)
    return -(-total // (num + den))


def _set_id(tokens: np.ndarray) -> int:
    """64-bit identity of a set of shingles."""
    if not len(tokens):
        return 0
    return int(np.bitwise_xor.reduce(mix64(tokens * np.uint64(0xC2B2AE3D27D4EB4F)))) ^ (len(tokens) * 0x9E3779B97F4A7C15 & MASK)


def hot_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The shingles that most documents share, most shared last (bounded by HOT_TOKENS)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for own in shingle_sets(as_bytes(batch.column(0)), k):
                held.append(own)
                size += len(own)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        yield flush()

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.filter(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "token").limit(HOT_TOKENS)
    return np.fromiter((r.token for r in top.collect()), dtype=np.int64)[::-1].view(np.uint64)


def shingle_table(docs: DataFrame, hot: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, sig, prefix, point): size and identity of every document's set, its prefix tokens and its point."""
    order = np.argsort(hot)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((hot[order], order.astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = shared.value
        for batch in batches:
            sizes, sigs, firsts, counts = [], [], [], []
            for own in shingle_sets(as_bytes(batch.column(1)), k):
                n = len(own)
                take = n - -(-num * n // den) + 1 if n else 0
                if n and len(tokens):
                    at = np.searchsorted(tokens, own)
                    at[at == len(tokens)] = 0
                    shared_by_many = tokens[at] == own
                    if shared_by_many.any():
                        late = own[shared_by_many][np.argsort(rank[at[shared_by_many]])]
                        own_first = np.concatenate([own[~shared_by_many], late])[:take]
                    else:
                        own_first = own[:take]
                else:
                    own_first = own[:take]
                sizes.append(n)
                sigs.append(_set_id(own))
                firsts.append(own_first)
                counts.append(point(own, group_count(n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, dtype=np.int64)), pa.array(np.array(sigs, dtype=np.uint64).view(np.int64)), binary_array(firsts), binary_array(counts)], names=["doc_id", "n", "sig", "prefix", "point"])

    return stage_table(docs.select("doc_id", "text").mapInArrow(prefixes, "doc_id long, n long, sig long, prefix binary, point binary"), "shingles")


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, n, prefix) -> one row per token; repeated sets of a batch once."""
    for batch in batches:
        sig = batch.column(0).to_numpy()
        _, pick = np.unique(sig, return_index=True)
        lists = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).take(pa.array(pick)).to_pylist()]
        sizes = [len(x) for x in lists]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(sig[pick], sizes)), pa.array(np.repeat(batch.column(1).to_numpy()[pick], sizes))], names=["token", "sig", "n"])


def _cells(num: int, den: int):
    """Sorted (token, n, sig) stream -> (cell, sig, n) for runs with two or more sets of close sizes.

    A run is a token's rows, cut where the next size is too large for the one before it; its cell is
    its first set. Repeated rows fall away. Constant memory: the state is the current run's first
    row and its last one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # token, sig, n of the last row; sig, n of the run's first row; whether that one is out
        for batch in batches:
            token, sig, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            if state:
                token, sig, n = np.concatenate([[state[0]], token]), np.concatenate([[state[1]], sig]), np.concatenate([[state[2]], n])
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (den * n[:-1] < num * n[1:])
            again = np.zeros(len(token), dtype=bool)
            again[1:] = ~new[1:] & (sig[1:] == sig[:-1]) & (n[1:] == n[:-1])
            if state:
                new[0] = False
                first = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
                cell, cell_n = np.where(first < 0, state[3], sig[first]), np.where(first < 0, state[4], n[first])
            else:
                first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
                cell, cell_n = sig[first], n[first]
            keep = ~new & ~again
            if state:
                keep[0] = False
            # every run with a second set also has a row of its first set
            cells = np.concatenate([cell[keep], cell[keep]])
            cells_n = np.concatenate([cell_n[keep], cell_n[keep]])
            out = np.unique(np.stack([cells, cells_n, np.concatenate([sig[keep], cell[keep]]), np.concatenate([n[keep], cell_n[keep]])]), axis=1)
            state = (token[-1], sig[-1], n[-1], cell[-1], cell_n[-1])
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(out[i]) for i in range(4)], names=["cell", "cell_n", "sig", "n"])
    return run


def group_count(n: int) -> int:
    """Coordinates of the point of a set of n shingles (a power of two)."""
    return max(GROUPS, 1 << max(0, (n - 1) // 8).bit_length())


def point(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Count vector: shingles per group (the top bits of the hash name the group)."""
    counts = np.bincount((tokens >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return np.minimum(counts, 65535).astype("<u2")


def _folded(points: list[np.ndarray]) -> np.ndarray:
    """Points with the fewest coordinates any of them has: neighbouring groups are added up."""
    groups = min(len(p) for p in points) if points else GROUPS
    return np.array([p.astype(np.int32).reshape(groups, -1).sum(axis=1) for p in points], dtype=np.int32).reshape(len(points), groups)


class CountTree:
    """R-tree over count vectors, bulk-loaded in order of size and leading coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(points) else np.zeros(0, int)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.compared = 0  # entries whose own bound was tried
        self.levels = []  # from the leaves up: upper corners and smallest / largest size of each node
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Entries whose overlap with the query may reach the threshold."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(0, int)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            fits = (den * high[nodes] >= num * size) & (num * low[nodes] <= den * size)
            nodes = nodes[fits]
            bound = np.minimum(top[nodes], point).sum(axis=1)
            # the least overlap any entry below would need: that of its smallest possible size
            floor = np.maximum(low[nodes], -(-num * size // den))
            nodes = nodes[bound >= _needed(floor, size, num, den)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        if not self.levels:
            nodes = np.arange(len(self.points))
        self.compared += len(nodes)
        bound = np.minimum(self.points[nodes], point).sum(axis=1)
        return self.order[nodes[bound >= _needed(self.sizes[nodes], size, num, den)]]


def surviving(points: np.ndarray, sizes: np.ndarray, left: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, entries that may be linked with it) for the first `left` points.

    Entries are the later points; of the first ones too if `left` is all of them.
    """
    base = left if left < len(sizes) else 0
    tree = CountTree(points[base:], sizes[base:])
    for q in range(left):
        found = tree.search(points[q], int(sizes[q]), num, den) + base
        yield q, found[found > q]


def linked_forest(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the components of the sets of one unit (`right` None: pairs within `left`).

    Indices above len(left) are those of `right`. A pair whose ends are joined already is skipped;
    every other pair that survives the tree is verified on the full sets.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = group_count(int(sizes.min())) if len(sets) else GROUPS
    points = _folded([point(s, groups) for s in sets])
    starts = np.cumsum(sizes) - sizes
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
    mark = np.zeros(len(tokens), dtype=np.int32)
    label = np.arange(len(sets))
    edges = []
    for q, found in surviving(points, sizes, len(left), num, den):
        found = found[label[found] != label[q]]
        if not len(found):
            continue
        mine = local[starts[q]:starts[q] + sizes[q]]
        mark[mine] = 1
        at = np.repeat(starts[found] - (np.cumsum(sizes[found]) - sizes[found]), sizes[found]) + np.arange(int(sizes[found].sum()))
        overlap = np.add.reduceat(mark[local[at]], np.cumsum(sizes[found]) - sizes[found])
        mark[mine] = 0
        for p in found[overlap >= _needed(sizes[found], sizes[q], num, den)].tolist():
            if label[p] != label[q]:
                label[label == label[p]] = label[q]
                edges.append((q, p))
    return edges


def _unit(table: pa.Table, payload: str, dtype: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """(sig, n, payload) of a unit's rows, those of block i first, and how many these are."""
    block = table.column("block").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    mine = np.flatnonzero(block == i)
    order = np.concatenate([mine, np.flatnonzero(block == j)]) if i != j else mine
    data = table.column(payload).to_pylist()
    return table.column("sig").to_numpy()[order], table.column("n").to_numpy()[order], [np.frombuffer(data[k], dtype=dtype) for k in order], len(mine)


def _unit_survivors(num: int, den: int):
    """Members with a partner that the bound lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        names = ["cell", "cell_n", "sig", "n"]

        def flush():
            rows = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=names)

        for unit in sorted_groups(batches, ["cell", "cell_n", "i", "j"]):
            sig, n, points, left = _unit(unit, "point", "<u2")
            keep = np.zeros(len(sig), dtype=bool)
            for q, found in surviving(_folded(points), n, left, num, den):
                if len(found):
                    keep[q] = True
                    keep[found] = True
            if keep.any():
                cell, cell_n = unit.column("cell")[0].as_py(), unit.column("cell_n")[0].as_py()
                m = int(keep.sum())
                out.append(np.stack([np.full(m, cell), np.full(m, cell_n), sig[keep], n[keep]]))
                size += m
                if size > 10_000:
                    yield flush()
                    out, size = [], 0
        yield flush()
    return run


def _unit_links(num: int, den: int):
    """Links between the sets of each unit, as a spanning forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for unit in sorted_groups(batches, ["cell", "cell_n", "i", "j"]):
            sig, _, sets, left = _unit(unit, "tokens", "<u8")
            for x, y in linked_forest(sets[:left], sets[left:] or None, num, den):
                a.append(sig[x])
                b.append(sig[y])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])
    return run


def _by_unit(cells: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """Work units of cells: rows of each pair of blocks together, with their `payload` (sig, n, ...)."""
    blocks = cells.groupBy("cell", "cell_n").agg((F.ceil(F.sum("n") / F.lit(block))).cast("int").alias("nb"))
    members = (cells.join(blocks, ["cell", "cell_n"])
               .withColumn("block", F.pmod(F.xxhash64("sig", "n"), F.col("nb")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
               .select("cell", "cell_n", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "n"))
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(payload, ["sig", "n"])
    return rows.repartition(parts, "cell", "cell_n", "i", "j").sortWithinPartitions("cell", "cell_n", "i", "j", "sig")


def ngram_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Groups of documents connected by shingle Jaccard similarity >= num / den.

    `docs` has doc_id and text (other columns are ignored, whatever their names). Returns one row per
    input row: doc_id, n_shingles (long, size of the distinct k-word shingle set), component_id (the
    smallest doc_id reachable over links). Words are lower-cased (A-Z) runs of anything but ASCII
    white space; a text of fewer than k words is one shingle; an empty or null text has no shingle and
    is its own component. A repeated row gets its result once per occurrence; rows that share a doc_id
    with different texts are one document, linked through their id. A null doc_id keeps its row,
    takes part through its text only and never names a component (null if nothing else is linked).
    """
    return _grouped(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """`ngram_components` with the identity `sig` of each row's set (null for rows without words)."""
    docs = docs.select("doc_id", "text")
    table = shingle_table(docs, hot_shingles(docs, k), k, num, den)
    sets = table.filter("n > 0").select("sig", "n", "prefix")
    rows = sets.mapInArrow(_token_rows, "token long, sig long, n long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartition(parts, "token").sortWithinPartitions("token", "n", "sig")
    cells = stage_table(runs.mapInArrow(_cells(num, den), "cell long, cell_n long, sig long, n long").distinct(), "cells")

    # members that the bound on their points lets through
    points = table.filter("n > 0").groupBy("sig", "n").agg(F.first("point").alias("point"))
    survivors = _by_unit(cells, points, BLOCK_POINTS).mapInArrow(_unit_survivors(num, den), "cell long, cell_n long, sig long, n long")
    cells = stage_table(survivors.distinct(), "survivors")

    # full sets of the members, recomputed from one document of each, or from the rows without doc_id that alone hold it
    nodes = cells.select("sig", "n").distinct()
    nodes = stage_table(table.select("doc_id", "sig", "n").join(nodes, ["sig", "n"]).groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id")), "nodes")
    ids, nameless = nodes.filter("doc_id is not null"), nodes.filter("doc_id is null").select("sig", "n")
    picked = ids.select("doc_id").distinct()
    if picked.count() <= BROADCAST_IDS:
        picked = F.broadcast(picked)

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingle_sets(as_bytes(batch.column(0)), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_set_id(s) for s in own], dtype=np.uint64).view(np.int64)), pa.array(np.array([len(s) for s in own], dtype=np.int64)), binary_array(own)], names=["sig", "n", "tokens"])

    sets_schema = "sig long, n long, tokens binary"
    full = docs.join(picked, "doc_id", "left_semi").select("text").mapInArrow(full_sets, sets_schema)
    if n_nameless := nameless.count():
        wanted = F.broadcast(nameless) if n_nameless <= BROADCAST_IDS else nameless
        full = full.unionByName(docs.filter("doc_id is null").select("text").mapInArrow(full_sets, sets_schema).join(wanted, ["sig", "n"], "left_semi"))
    units = _by_unit(cells, full.dropDuplicates(["sig", "n"]), BLOCK_SHINGLES)
    links = units.mapInArrow(_unit_links(num, den), "a long, b long")

    # links between sets, and between a set and the ids that hold it; nodes are sets
    heads = table.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("head"))
    held = table.filter("n > 0 and doc_id is not null").select("doc_id", "sig")
    several = stage_table(held.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a < b").select("doc_id", "a"), "ids")
    if several.count() <= BROADCAST_IDS:
        several = F.broadcast(several)
    same_id = held.join(several, "doc_id").filter("a < sig").select("a", F.col("sig").alias("b")).distinct()
    groups = connected_components(links.unionByName(same_id))
    named = heads.join(groups, heads["sig"] == groups["node"], "left").select("sig", F.coalesce("component", "sig").alias("component"), "head")
    named = stage_table(named, "named")
    lowest = named.groupBy("component").agg(F.min("head").alias("component_id"))
    by_set = named.select("sig", "component").join(lowest, "component").select("sig", "component_id")
    alone = table.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("sig"))
    return table.filter("n > 0").select("doc_id", "n", "sig").join(by_set, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "sig").unionByName(alone)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of the document with the smallest doc_id of each near-duplicate group, all columns kept.

    A document without words stays; of repeated rows with one doc_id all stay. A row without doc_id
    stays unless it is linked to a document that has one.
    """
    if docs.filter("doc_id is null").isEmpty():
        return _named_heads(docs, ngram_components(docs))
    groups = stage_table(_grouped(docs, 5, 4, 5), "groups")
    linked = groups.filter("doc_id is null and component_id is not null").select(F.col("sig").alias("_linked")).distinct()
    rows, kept, schema = extended(docs.filter("doc_id is null"), "_set long")
    at = kept.index("text")

    def set_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.array([_set_id(s) for s in shingle_sets(as_bytes(batch.column(at)), 5)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs)], names=[*kept, "_set"])

    nameless = rows.mapInArrow(set_ids, schema)
    nameless = nameless.join(linked, nameless["_set"] == linked["_linked"], "left_anti").drop("_set")
    return _named_heads(docs, groups).unionByName(nameless)


def _named_heads(docs: DataFrame, groups: DataFrame) -> DataFrame:
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs["doc_id"] == keep["_kept"], "left_semi")
