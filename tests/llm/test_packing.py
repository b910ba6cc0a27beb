"""Packing: every id of every document in one piece, sequences without gaps, no padding but at powers of two."""

import random
from collections import defaultdict
from struct import unpack

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnkit.llm import packing
from churnkit.llm.packing import Packer, WordTokenizer, pack_documents, powers_of_two, text_chunks
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def numbers(raw):
    return list(unpack(f"<{len(raw) // 4}I", raw))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(rows, expected, length):
    """`expected`: the ids of each document, by number."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) // 4 > 0
    assert set(pieces) == set(expected)
    for doc, found in pieces.items():
        ids = []
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == len(ids) and r.doc_tokens == len(expected[doc])
            ids += numbers(r.ids)
        assert ids == expected[doc]
    short = []
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        if at < length:
            assert at & (at - 1) == 0
            short.append(at)
    assert len(short) == len(set(short))
    assert len(sequences) - len(short) == sum(map(len, expected.values())) // length


def test_words_like_whole_texts(library):
    texts = ["Don't STOP 12345 naïve Straße İstanbul ΣΑΣ éa ́x 你好吗 😀👍🏽", "a\x1cb\x85c d​e \x00 \x7f", "<|endoftext|> a<|endoftext|>b", "", " ",
             "x" * 5000, "ẛ̣ ﬁ ﷺ K Å", "'s' t're we'LL I'D", "\t\n\x0b\x0c\r a", "ﬀ̖̀ ̖̀"]
    draw = random.Random(2)
    texts += ["".join(draw.choice("aB9'é́ \n.,ßİ😀中 　-") for _ in range(200)) for _ in range(50)]
    own = WordTokenizer(PATH, False)
    assert own.cut is not None
    texts += ["".join(chr(c) for c in range(0x21, 0x250)), *map(chr, range(0x21, 0x3000, 7))]
    for t in texts:
        assert numbers(own.encode(pa.array([t]))[0]) == library.encode(t, add_special_tokens=False).ids
    own.cut = None
    assert all(numbers(own.encode(pa.array([t]))[0]) == library.encode(t, add_special_tokens=False).ids for t in texts)
    found = own.encode(pa.array([None, *texts, None, ""], type=pa.string()).slice(1))
    assert [numbers(x) for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts] + [[], []]
    assert own.encode(pa.array([], type=pa.string())) == [] and own.encode(pa.array([" ", None])) == [b"", b""]
    special = WordTokenizer(PATH, True)
    assert numbers(special.encode(pa.array(["a <|endoftext|>b"]))[0]) == Tokenizer.from_file(PATH).encode("a <|endoftext|>b", add_special_tokens=False).ids


def test_every_document_of_the_small_table(spark, library):
    from churnkit.llm.queries import read

    own = WordTokenizer(PATH, False)
    for r in read(spark, "/root/testdata/sf0.01", "documents").collect():
        assert numbers(own.encode(pa.array([r.text]))[0]) == library.encode(r.text or "", add_special_tokens=False).ids


def test_memory_of_words_in_generations(monkeypatch, library):
    monkeypatch.setattr(packing, "MEMO_SIZE", 5)
    own = WordTokenizer(PATH, False)
    for i in range(30):
        t = f"word{i % 7} other{i} " + "long" * 30
        assert numbers(own.encode(pa.array([t]))[0]) == library.encode(t, add_special_tokens=False).ids
        assert len(own.words) <= 8 and len(own.pieces) <= 8


def test_chunks_of_texts():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c" * 5, "d"])
    for size in (1, 12, 60, 1000):
        ranges = list(text_chunks(texts, size))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(6))
    assert list(text_chunks(texts, 1)) == [(i, i + 1) for i in range(6)] and list(text_chunks(texts, 1000)) == [(0, 6)]


def test_best_fit_bounded_and_topped_up():
    p = Packer(8, 2, 0)
    ids = lambda n: b"\1\0\0\0" * n
    p.add("a", 0, ids(5), 5)
    p.add("b", 0, ids(4), 4)     # a second window: no room in the first
    p.add("c", 0, ids(3), 3)     # tightest fit is the first, which is full then
    assert [(r[0], r[4], r[5]) for r in p.taken()] == [("a", 0, 0), ("c", 0, 5)]
    p.add("d", 0, ids(6), 6)
    p.add("e", 0, ids(5), 5)     # none has room: the fullest (d) is topped up by two, three go to b
    assert [(r[0], r[1], len(r[2]) // 4, r[5]) for r in p.taken()] == [("d", 0, 6, 0), ("e", 0, 2, 6)]
    assert [[(q[0], q[1], len(q[2]) // 4) for q in s] for s in powers_of_two(p.merge())] == [[("b", 0, 4)], [("e", 2, 2)], [("e", 4, 1)]]


def test_packs_all_rounds(spark, monkeypatch, library):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randint(0, 99)}" for _ in range(draw.choice([0, 1, 5, 40, 300]))) for _ in range(200)] + [None, ""]
    docs = documents(spark, texts).withColumn("ids", F.lit("clash")).withColumn("Part", F.lit(0)).repartition(11)
    out = pack_documents(docs, PATH, length=256, windows=4)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}, 256)


def test_repeated_and_missing_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", None), ("x", "c")], "doc_id string, text string").coalesce(1)
    rows = pack_documents(docs, PATH, length=16).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1 + 2
    assert sorted({r.doc_tokens for r in rows if r.doc_id is None}) == [3] and sorted({r.doc_tokens for r in rows if r.doc_id}) == [1, 2]
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    from churnkit.llm.queries import QUERIES, read

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op13_packing"](spark, sf).collect()
    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in read(spark, sf, "documents").collect()}
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    from struct import pack
    from zlib import crc32
    for r in rows:
        ids = docs[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == crc32(pack(f"<{len(ids)}I", *ids)) and r.doc_tokens == len(docs[r.doc_id])
