"""Order MinHash fingerprints: edited texts, order and repeats, against a plain re-computation of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from churnkit.llm import fingerprint as fp
from tests.llm.helpers import documents


def signatures(spark, texts):
    return {r.doc_id: list(r.signature) for r in fp.fingerprints(documents(spark, texts)).collect()}


def plain_signatures(spark, texts):
    """The same rules row by row: k-mers exploded, numbered by a window, dealt and picked with Python."""
    from collections import defaultdict

    df = documents(spark, texts).select("doc_id", F.regexp_extract_all("text", F.lit(r"\S{1,16}"), F.lit(0)).alias("t"))
    grams = {r.doc_id: r.g for r in df.select("doc_id", F.when(F.size("t") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - fp.GRAM, F.lit(0))),
             lambda i: F.xxhash64(F.slice("t", i + 1, fp.GRAM)))).otherwise(F.array().cast("array<bigint>")).alias("g")).collect()}
    rows = []
    for d, g in grams.items():
        kept, seen = set(sorted(set(g))[:fp.KEPT]), defaultdict(int)
        for place, code in enumerate(g):
            if code in kept:
                rows.append((d, code, seen[code], place))
                seen[code] += 1
    dealt = defaultdict(list)
    for r in spark.createDataFrame(rows, "d long, c long, n int, place int").select("d", F.xxhash64("c", "n").alias("code"), "place").collect():
        dealt[r.d].append((r.code, r.place))
    picked = []
    for d, own in dealt.items():
        bins = defaultdict(list)
        for code, place in sorted(own):
            bins[code >> 59].append((place, code))
        picked += [(d, b, [c for _, c in sorted(v[:fp.TUPLE])]) for b, v in bins.items()]
    out = {d: [] for d in grams}
    for r in spark.createDataFrame(picked, "d long, b long, t array<bigint>").select("d", "b", F.shiftrightunsigned(F.xxhash64("t"), 24).alias("h")).collect():
        out[r.d].append(((r.b + 16) << 40) | r.h)
    return {d: sorted(v) for d, v in out.items()}


def texts_of(seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 2, 3, 10, 100, 400, 1500)]
    return out + ["line one\n" * 500, "x" * 5000, "", "a b c d " * 4]


def test_like_plain_rules(spark):
    texts = texts_of()
    assert signatures(spark, texts) == plain_signatures(spark, texts)


def test_order_and_repeats_matter(spark):
    words = [f"w{i}" for i in range(200)]
    blocks = [words[i:i + 10] for i in range(0, 200, 10)]
    moved = [w for b in reversed(blocks) for w in b]
    texts = [" ".join(words), " ".join(words), " ".join(moved), " ".join(words[:190] + ["new"] * 10), " ".join(words) + " tail", None, ""]
    s = signatures(spark, texts)
    assert s[0] == s[1] and s[5] == s[6] == []

    def alike(a, b):
        bins = {x >> 40 for x in s[a]} | {x >> 40 for x in s[b]}
        return len(set(s[a]) & set(s[b])) / len(bins)

    assert alike(0, 4) > alike(0, 3) > alike(0, 2)


def test_edited_texts(spark):
    texts = texts_of(2) + [None, "é" * 9, "短い"]
    docs = documents(spark, texts).withColumns({"signature": F.lit(1), "next_text": F.lit(2)})
    rows = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        assert rows[i].edited == t[:len(t) - k] + after[:k] and rows[i].n_chars == len(t)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[6].near_edited > rows[6].near_next + 0.2


@pytest.mark.parametrize("rows", [1, 3, 7, 50])
def test_next_row_over_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    ids = random.Random(rows).sample(range(-1000, 10 ** 6), 60)
    df = spark.createDataFrame([(i, str(i)) for i in ids] + [(None, "none"), (ids[0], "again")], "doc_id long, text string").repartition(5)
    order = sorted([(i, str(i)) for i in ids] + [(-10 ** 9, "none"), (ids[0], "again")])
    got = {r.text: r.next_text for r in fp.with_next(df, ["text"]).collect()}
    assert got == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}


def test_empty_table_and_single_row(spark):
    assert fp.edited_fingerprints(documents(spark, []).limit(0)).count() == 0
    r = fp.edited_fingerprints(documents(spark, ["abcdefgh"])).first()
    assert r.edited == "abcdefab" and r.near_next == 1.0
