"""Periodic runs: against comparing every word with the word q further, for every q; the planted texts of the query."""

import hashlib
import random
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnkit.llm.runs import find_runs, periodic_runs, runs_of_texts
from tests.llm.helpers import documents


def plain_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            piece = w[s:e]
            smaller = any(all(piece[k] == piece[k + p] for k in range(len(piece) - p)) for p in range(1, q))
            if e - s >= max(least, exponent * q) and not smaller:
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(draw):
    w = [draw.choice("abc") for _ in range(draw.randint(0, 30))]
    if w:
        p = draw.randint(1, min(6, len(w)))
        a = draw.randint(0, len(w) - p)
        w = w[:a] + w[a:a + p] * draw.randint(1, 7) + w[a + p:]
    return w


def test_like_brute_force_in_shared_arrays():
    draw = random.Random(5)
    for least, exponent in ((6, 4), (2, 2), (1, 3)):
        texts = [repetitive(draw) for _ in range(300)]
        found = list(runs_of_texts([" ".join(w).encode() for w in texts], least, exponent))
        for w, (n, runs, collapsed) in zip(texts, found, strict=True):
            assert n == len(w) and runs == plain_runs(w, least, exponent)
            assert collapsed.decode() == plain_collapsed(w, runs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), max_size=4))
def test_any_texts(texts):
    found = list(runs_of_texts([t.encode() for t in texts], 2, 2))
    assert [r for _, r, _ in found] == [plain_runs(t.split(), 2, 2) for t in texts]


def test_long_texts_stay_cheap():
    t0 = time.time()
    for w, runs in (([b"a"] * 200_000, [(0, 200_000, 1)]), ([b"a", b"b"] * 100_000, [(0, 200_000, 2)]),
                    ([b"a"] * 100_000 + [b"c"] + [b"a", b"d"] * 50_000, [(0, 100_000, 1), (100_001, 100_000, 2)])):
        assert next(iter(runs_of_texts([b" ".join(w)], 6, 4)))[1] == runs
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a
    assert next(iter(runs_of_texts([b" ".join(b)], 6, 4)))[1] == []   # no run of a Fibonacci word reaches four periods
    assert time.time() - t0 < 60


def test_edge_cases_in_spark(spark):
    texts = [None, "", " \t\n", "x", "a a a a a a", "a a a a a", "a b " * 8, "né\x1fè " * 4 + "end", "a b a b a b a b a b"]
    docs = documents(spark, texts).withColumn("N_words", F.lit("clash")).withColumn("runs", F.lit(1)).union(
        documents(spark, [texts[4]]).withColumn("N_words", F.lit("clash")).withColumn("runs", F.lit(1)))
    out = periodic_runs(docs)
    assert sorted(c.lower() for c in out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "n_words", "runs", "collapsed"])
    for r in out.collect():
        w = [x.decode() for x in (r.text or "").encode().split()]
        runs = [tuple(x) for x in r.runs]
        assert (r.n_words, runs, r.collapsed) == (len(w), plain_runs(w), plain_collapsed(w, runs))
    assert out.filter("size(runs) > 0").count() == 4
    assert periodic_runs(docs.limit(0)).count() == 0


def test_find_runs_of_nothing():
    import numpy as np
    assert find_runs(np.array([0]), 6, 4) == []


def test_query(spark, tmp_path):
    from churnkit.llm.queries import QUERIES

    draw = random.Random(9)
    texts = [" ".join(draw.choice(["the", "of", f"w{draw.randint(0, 50)}"]) for _ in range(draw.randint(0, 120))) for _ in range(300)] + [None, "", "a  a\ta a a a"]
    docs = documents(spark, texts)
    docs = docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    changed = 0
    for r in rows:
        w = ((texts[r.doc_id] if r.doc_id is not None else texts[0]) or "").split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
    assert changed > 10
