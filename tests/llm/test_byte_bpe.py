"""Byte-level BPE: against a plain merge loop and the public library, and an exact round trip."""

import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from churnkit.llm.byte_bpe import Encoder, PerfectHash, decode_documents, encode_documents, merge_bytes, read_ranks
from tests.llm.helpers import documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "  \n\n a  b", "x" * 30_000, "żółć 你好 😀 don't we'll 12345 \t\t", "a\x00c <|endoftext|>", "idiotidiot" * 300, "Hello world"]


def plain_merges(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_perfect_hash_is_minimal_and_exact():
    keys = read_ranks(PATH)
    index = PerfectHash(keys)
    assert sorted(index.key_at.tolist()) == list(range(len(keys)))
    assert index.find(keys, keys).tolist() == list(range(len(keys)))
    known = set(keys)
    others = [k + b"\x00q" for k in keys[:5000] if k + b"\x00q" not in known]
    assert set(index.find(others, keys).tolist()) == {-1}
    assert PerfectHash([b"a"]).find([b"a", b"b", b""], [b"a"]).tolist() == [0, -1, -1]


def test_heap_merges_like_a_plain_loop():
    ranks = {t: r for r, t in enumerate(read_ranks(PATH))}
    draw = random.Random(1)
    pieces = [bytes(draw.choice(b"aeiotnsh \xc3\xa9") for _ in range(draw.randint(1, 40))) for _ in range(500)] + [b"a" * 200]
    for p in pieces:
        assert merge_bytes(p, ranks) == plain_merges(p, ranks)


def test_like_the_library_and_round_trip(spark):
    tokens = read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
    docs = documents(spark, TEXTS).withColumn("N_TOKENS", F.lit("clash"))
    out = decode_documents(encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted(c.lower() for c in out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "token_ids", "decoded"])
    for r in out.collect():
        expected = library.encode_ordinary(r.text or "")
        ids = [int.from_bytes(r.token_ids[i:i + 4], "little") for i in range(0, len(r.token_ids), 4)]
        assert ids == expected and r.n_tokens == len(expected)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_memo_starts_afresh(monkeypatch):
    from churnkit.llm import byte_bpe
    monkeypatch.setattr(byte_bpe, "MEMO_SIZE", 5)
    tokens = read_ranks(PATH)
    encoder = Encoder(tokens, PerfectHash(tokens), public_tokenizers.PATTERN)
    again = [encoder.encode([f"word{i} other{i} thing{i}"]) for i in range(20)]
    assert again[3] == encoder.encode(["word3 other3 thing3"])


def test_rank_file(tmp_path):
    path = tmp_path / "v"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"ab") + b" 1\n")
    assert read_ranks(str(path)) == [b"a", b"ab"]
