"""N-gram Jaccard join: against all pairs, and on awkward inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.llm import ngram_join as nj
from churnkit.llm.components import connected_components
from churnkit.llm.wordhash import shingle_sets
from tests.llm.helpers import components, documents, shingles


def near_copies(seed=5, bases=6, copies=14):
    draw = random.Random(seed)
    out = []
    for b in range(bases):
        base = [f"w{draw.randint(0, 4000)}" for _ in range(draw.choice([3, 20, 80, 200, 700]))]
        shared = [f"passage{i}" for i in range(30)]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = f"x{draw.randint(0, 10 ** 6)}"
            if draw.random() < 0.3:
                words += shared
            out.append(" ".join(words))
    return out


def check(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(documents(spark, texts)).collect()}
    roots, sizes = components(texts)
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}


def test_shingle_sets_match_plain_words():
    texts = ["", None, " \n\t", "a", "A b", "a b c d e f A B c d e", "é É x y z", "x" * 50_000, "a\x1cb c\x0bd"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_against_all_pairs(spark):
    check(spark, near_copies())


def test_blocks_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(nj, "BLOCK_POINTS", 3000)
    monkeypatch.setattr(nj, "HOT_DOCS", 4)
    check(spark, near_copies(seed=9, bases=2, copies=45))


def test_awkward_texts(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    check(spark, ["", None, "one two", "One  TWO", "one two three", "  \n", long, long + " tail", "same words here now ok", "same words here now ok", "é É", "é é"])


def test_repeated_rows_null_ids_clashing_columns_and_no_rows(spark):
    df = documents(spark, ["a b c d e f g", "x y"]).withColumns({"token": F.lit(1), "sig": F.lit("s"), "component_id": F.lit(7)})
    out = nj.ngram_components(df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in out.collect()) == [
        (False, 0, 3, 0), (False, 0, 3, 0), (False, 1, 1, 1), (False, 1, 1, 1), (True, 0, 1, 1), (True, 0, 3, 0)]
    assert nj.ngram_components(df.limit(0)).count() == 0
    kept = nj.keep_one_of_each_group(documents(spark, ["a b c d e f", "A b c d e f", "", "", "z"]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.columns == df.columns[:5]


def test_null_id_near_copies_and_three_texts_under_one_id(spark):
    def text(changed, start=0, stop=100):
        return " ".join(f"x{changed}" if i == changed else f"w{i}" for i in range(start, stop))

    # 10 and 20 are linked through the text without doc_id only; 30 has three texts, each with a near copy
    rows = [(10, text(None, 0, 100)), (None, text(None, 8, 108)), (20, text(None, 16, 116)), (None, "on its own here now ok yes")]
    rows += [(30, text(None, a, a + 100)) for a in (1000, 2000, 3000)] + [(31 + a, text(a * 1000 + 1, a * 1000, a * 1000 + 100)) for a in (1, 2, 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents(spark, []).schema)
    got = sorted((r.doc_id or 0, r.component_id) for r in nj.ngram_components(docs).collect() if r.component_id)
    assert got == [(0, 10), (10, 10), (20, 10), (30, 30), (30, 30), (30, 30), (32, 30), (33, 30), (34, 30)]
    kept = nj.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text[:6]) for r in kept.collect()) == [(0, "on its"), (10, "w0 w1 "), (30, "w1000 "), (30, "w2000 "), (30, "w3000 ")]


def test_tree_never_loses_a_pair():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2 ** 63, 600, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(600) < 0.93], draw.integers(0, 2 ** 63, 30, dtype=np.uint64)])) for _ in range(150)]
    sets += [np.unique(draw.integers(0, 2 ** 63, int(n), dtype=np.uint64)) for n in draw.integers(1, 900, 100)]
    sizes = np.array([len(s) for s in sets])
    points = nj._folded([nj.point(s, nj.group_count(len(s))) for s in sets])
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    found = {(q, int(p)) for q, own in nj.surviving(points, sizes, len(sets), 4, 5) for p in own}
    assert linked and linked <= found
    assert len(found) < len(sets) ** 2 / 4


def test_components_of_paths(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("members", [0, 1, 2, 17, 40, 200])
def test_every_unit_is_searched_through_a_tree_that_prunes(monkeypatch, members):
    built = []

    class Watched(nj.CountTree):
        def __init__(self, *given):
            super().__init__(*given)
            built.append(self)

    monkeypatch.setattr(nj, "CountTree", Watched)
    draw = np.random.default_rng(members)
    points = draw.integers(0, 4, (members, 64)).astype(np.int32)
    points[members // 2:] *= 3
    sizes = points.sum(axis=1)
    found = {(q, int(p)) for q, own in nj.surviving(points, sizes, members, 4, 5) for p in own}
    bound = {(i, j) for i in range(members) for j in range(i + 1, members) if 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])}
    assert found == bound and len(built) == 1
    if members >= 40:
        assert built[0].compared < 0.7 * members ** 2
