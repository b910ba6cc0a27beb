"""Benchmark decontamination against plain window search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from churnkit.llm import decontamination
from churnkit.llm.decontamination import contamination, decontaminate
from tests.llm.helpers import documents, lower_ascii


def words_of(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", lower_ascii(text))


def plain(text, items):
    words, hit, ids = words_of(text), set(), set()
    for i, item in items:
        w = words_of(item)
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if w else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[j:j + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
    return len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)


def fixture(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "12"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([40, 13, 14, 5, 1, 0, 12, 60, 25])]
    items += [(20, "Again again, again again again again again again again again again again again again again again"), (21, None), (22, "!!!"), (7, items[7][1])]
    texts = ["", None, "...", "again " * 40, "Again " * 15]
    for _ in range(120):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            own = words_of(draw.choice(items)[1])
            a = draw.randint(0, max(0, len(own) - 5))
            words[draw.randint(0, len(words)):0] = own[a:a + draw.randint(8, 30)]
        texts.append(", ".join(w.upper() if draw.random() < 0.2 and w.isascii() else w for w in words))
    texts.append(" ".join(f"z{i}" for i in range(20_000)) + " " + items[0][1])
    return texts, items


def test_like_plain_search(spark):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in contamination(documents(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t, items), t[:100] if t else t


def test_awkward_tables(spark):
    texts, items = fixture(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts[:20]).withColumns({"words": F.lit(1), "hits": F.lit(2), "item_id": F.lit(3)})
    assert contamination(docs.limit(0), bench).count() == 0
    clean = contamination(docs, bench.limit(0))
    assert clean.filter("n_hit > 0 or contaminated").count() == 0 and clean.count() == 20
    twice = contamination(docs.unionByName(docs), bench)
    assert twice.count() == 40 and twice.distinct().count() <= 20
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_hit for r in contamination(nameless, bench).collect()) == sorted(plain(t, items)[1] for t in texts[:20])
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts[:20]) if not plain(t, items)[3]]


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_joins_of_hits_agree(spark, monkeypatch):
    texts, items = fixture(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [*texts, "a b c", None])
    sent = sorted(contamination(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert sorted(contamination(docs, bench).collect()) == sent
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_passage_repeated_in_one_text(spark):
    """A text that holds a passage of repeats thousands of times."""
    item = "la " * 40
    docs = documents(spark, ["la " * 6000, "x " * 500 + "la " * 12])
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: (6000, 6000, True), 1: (512, 0, False)}
