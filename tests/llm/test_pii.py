"""Personal data: base spans against plain regular expressions, discovered spans against brute-force scoring."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from churnkit.llm import pii
from tests.llm.helpers import documents

KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
CASES = ["", None, "a@b.co_x@y.com z", "a@b.c.d..e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "+1 (403) 555-9312. +12-34 +1234567890123456",
         "4111-1111 1111 1111", "4111  1111 1111 1111 4111111111111111", "5 5-5 5--5 4539578763621486 x", "x@y é@b.com aé@é.com a@b-c.d-e", " a@b.com  +1 2222222222",
         "12345678901234567890 " * 50, "1 " * 8000, "a." * 8000 + "@b.c", "a@" + "b." * 8000 + "c", "w" * 40_000, "0000000000000000 00000000000000", "a@b.c-.d"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def spans(rows):
    return [(r.start, r.kind, r.end) for r in rows]


def test_base_spans(spark):
    draw = random.Random(3)
    texts = CASES + ["".join(draw.choice("aZ09 .-@+()_%\n4") for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    for r in pii.personal_data(documents(spark, texts)).collect():
        assert spans(r.base) == plain_base(texts[r.doc_id]), texts[r.doc_id][:80]
        assert set(spans(r.base)) <= set(spans(r.spans))


def brute_force(edges):
    """Scores of the pattern-instance graph, turn by turn, with plain dictionaries."""
    kind_of, graph = {}, defaultdict(set)
    for pattern, code, kind in edges:
        graph[pattern].add(code)
        if kind is not None:
            kind_of[code] = min(kind, kind_of.get(code, 9))
    places = defaultdict(set)
    for p, codes in graph.items():
        for c in codes:
            if c not in kind_of:
                places[c].add(p)
    worth = {(c, k): 1.0 for c, k in kind_of.items()}
    for _ in range(pii.TURNS):
        trust = defaultdict(float)
        for p, codes in graph.items():
            for (c, k), w in worth.items():
                if c in codes:
                    trust[p, k] += w / (len(codes) + pii.DOUBT)
        worth = {(c, k): 1.0 for c, k in kind_of.items()}
        for c, own in places.items():
            for k in range(4):
                total = sum(trust.get((p, k), 0.0) for p in own)
                if total:
                    worth[c, k] = total / len(own)
    return {c: max((w, -k) for (d, k), w in worth.items() if d == c) for c in places if any(d == c for d, _ in worth)}


def test_discovered_spans(spark):
    texts = [f"please call +1 (403) 555-{1000 + i} today" for i in range(30)]
    texts += ["please call +1 (403) 555-99 or card 41111", "my mail is nobody@host and more", "version 3.0 of 2024"]
    texts += [f"write to user{i}@mail.example.com now" for i in range(30)] + ["write to user77@mail now", "write to user5@mail.example.com now"]
    texts += [f"server 10.0.0.{100 + i} up" for i in range(20)] + ["server 10.0.0.999 up", "server 300.0.0.1 up"]
    docs = documents(spark, texts)
    found = pii._with_spans(docs)
    edges = [(r.pattern, r.code, r.kind) for r in pii._edges(found).collect()]
    scores = brute_force(edges)
    expected = {(r.doc_id, r.start, r.end) for r in pii._edges(found).filter("kind is null").collect() if scores.get(r.code, (0, 0))[0] >= pii.ACCEPT}
    got = {(r.doc_id, r.start, r.end): r.kind for r in pii.discovered(found).collect()}
    assert set(got) == expected
    shown = {texts[d][a:b]: k for (d, a, b), k in got.items()}
    assert shown.get("10.0.0.999") == 1 and "3.0" not in shown and "2024" not in shown


def test_redaction_and_awkward_tables(spark):
    texts = ["mail a.b@c.org or +1 403 555 9312!", None, "", "no data", "é a@b.com é"]
    docs = documents(spark, texts).withColumns({"spans": F.lit(1), "base": F.lit(2), "kind": F.lit(3)})
    out = pii.redact(docs.unionByName(docs))
    assert out.columns == docs.columns and out.count() == 10
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].text for i in range(5)] == ["mail [EMAIL] or [PHONE]!", None, "", "no data", "é [EMAIL] é"]
    assert rows[0].n_chars == len(rows[0].text) and rows[3].n_chars == 7 and rows[0].spans == 1
    assert pii.personal_data(docs.limit(0)).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(len(r.base) for r in pii.personal_data(nameless).collect()) == [0, 0, 0, 1, 2]


@pytest.mark.parametrize("value,good", [("4539578763621486", True), ("4539578763621487", False), ("0", True)])
def test_luhn(spark, value, good):
    assert spark.range(1).select(pii.luhn(F.lit(value))).first()[0] is good


def test_word_before_a_token_is_whole(spark):
    long = "x" * 60
    texts = [f"alpha{long} 5 beta{long} 6", "word" + " " * 300 + "7", "a\n\n 8 9@b\t10", "11", " 12", "w" * 30_000 + " 13 " + "v " * 20_000 + "14", "é" * 50 + "1 15", ""]
    got = {(r.doc_id, r.t.start): r.t.before for r in documents(spark, texts).select("doc_id", F.explode(pii.tokens(F.col("text"))).alias("t")).collect()}
    expected = {}
    for i, text in enumerate(texts):
        runs = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
        for j, (at, run) in enumerate(runs):
            if re.search("[0-9@]", run):
                near = runs[j - 1][1].lower() if j else ""
                expected[i, at] = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]", "9", near)) if re.search("[0-9]", near) else near
    assert {k: v for k, v in got.items() if k[0] != 6} == {k: v for k, v in expected.items() if k[0] != 6}
    assert got[6, 52] == expected[6, 52]
