"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: every key has its own slot
in a table as long as the vocabulary) resolves pre-tokens that are vocabulary entries as a whole, for
all distinct pre-tokens of a batch in a few array operations. Tier two: what misses is merged from its
bytes, taking the lowest-ranked neighbouring pair first (leftmost among equals) off a heap over a
linked list of byte pieces, so a pre-token of n bytes costs n log n, however long it is.

The vocabulary is read on the driver and broadcast (its size is fixed by the file, a few megabytes).
Tasks keep a bounded memo of pre-tokens; documents are processed whole, without any shuffle.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from churnkit.llm.tables import as_bytes, extended
from churnkit.llm.wordhash import chunks, mix64, word_hashes

#: pre-tokens remembered by a task before it starts afresh
MEMO_SIZE = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary of a rank file (base64 token, space, rank), by rank."""
    pairs = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pairs[int(rank)] = base64.b64decode(token)
    return [pairs[r] for r in range(len(pairs))]


def string_hashes(strings: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, without a loop over them."""
    size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    ends = np.cumsum(size)
    return word_hashes(np.frombuffer(b"".join(strings) or b"\0", dtype=np.uint8), ends - size, ends)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by hash and displace.

    Keys fall into about n / 3 buckets. Buckets with several keys, largest first, take the first
    displacement that sends all their keys to free slots; single keys then take the slots left over
    (stored as negative numbers). `slots` gives a candidate slot for any string; `keys[slot]` decides.
    """

    def __init__(self, keys: list[bytes]):
        self.size = n = len(keys)
        self.buckets = max(1, n // 3)
        code = string_hashes(keys)
        if len(np.unique(code)) != n:
            raise ValueError("keys must be distinct")
        bucket = (code % np.uint64(self.buckets)).astype(np.int64)
        one, step = self._two(code)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        sizes = np.diff(ends, prepend=0)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slot_of = np.full(n, -1, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own = order[ends[b] - sizes[b]:ends[b]]
            d = 0
            while True:
                tries = np.sort((one[own][:, None] + step[own][:, None] * np.arange(d, d + 64)) % n, axis=0)
                good = free[tries].all(axis=0) & (np.diff(tries, axis=0) > 0).all(axis=0)
                if good.any():
                    d += int(np.argmax(good))
                    break
                d += 64
            slot_of[own] = (one[own] + step[own] * d) % n
            free[slot_of[own]] = False
            self.shift[b] = d
        single = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(free)
        own = order[ends[single] - 1]
        slot_of[own] = rest[:len(single)]
        self.shift[single] = -1 - rest[:len(single)]
        self.key_at = np.empty(n, dtype=np.int64)
        self.key_at[slot_of] = np.arange(n)
        self.code_at = np.empty(n, dtype=np.uint64)
        self.code_at[slot_of] = code

    def _two(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = mix64(code ^ np.uint64(0x5851F42D4C957F2D))
        n = np.uint64(self.size)
        return (other % n).astype(np.int64), (1 + (other >> np.uint64(32)) % np.uint64(max(1, self.size - 1))).astype(np.int64)

    def find(self, strings: list[bytes], keys: list[bytes]) -> np.ndarray:
        """Index of each string among the keys, or -1."""
        if not strings or not self.size:
            return np.full(len(strings), -1, dtype=np.int64)
        code = string_hashes(strings)
        shift = self.shift[(code % np.uint64(self.buckets)).astype(np.int64)]
        one, step = self._two(code)
        slot = np.where(shift < 0, -1 - shift, (one + step * np.maximum(shift, 0)) % self.size)
        found = np.where(self.code_at[slot] == code, self.key_at[slot], -1)
        for i in np.flatnonzero(found >= 0).tolist():
            if keys[found[i]] != strings[i]:
                found[i] = -1
        return found


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: merge the lowest-ranked neighbouring pieces until none is in the vocabulary."""
    n = len(piece)
    rank = ranks.get
    after = list(range(1, n + 2))   # start of the next piece; 0 for a piece that was merged away
    before = list(range(-1, n))     # start of the piece before
    heap = []
    for i in range(n - 1):
        r = rank(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        j = after[i]
        if not j or j >= n or after[j] != stop:
            continue
        after[j] = 0
        after[i] = stop
        if stop < n:
            before[stop] = i
            longer = after[stop]
            r = rank(piece[i:longer])
            if r is not None:
                push(heap, (r, i, longer))
        k = before[i]
        if k >= 0:
            r = rank(piece[k:stop])
            if r is not None:
                push(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """Ids of texts, two-tier: perfect hash for whole pre-tokens, byte merges for the rest."""

    def __init__(self, tokens: list[bytes], index: PerfectHash, pattern: str):
        self.tokens, self.index = tokens, index
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Resolve pre-tokens that the memo does not hold."""
        memo = self.memo
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO_SIZE:
            memo.clear()
            new = list(pieces)
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        for piece, own, rank in zip(new, raw, self.index.find(raw, self.tokens).tolist(), strict=True):
            if rank >= 0:
                memo[piece] = rank.to_bytes(4, "little")
            else:
                ids = merge_bytes(own, self.ranks)
                memo[piece] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = list(map(self.split, texts))
        self.learn(set().union(*split))
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


_ENCODERS: dict[tuple, Encoder] = {}


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` plus n_tokens (long) and token_ids (binary, little-endian unsigned 32-bit ids).

    Each match of `pattern` is encoded separately by the ranks in the file `vocabulary`; there are no
    special tokens. A null text encodes as an empty one. Columns named n_tokens or token_ids are
    replaced; all other columns and every row are kept as they are.
    """
    tokens = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    rows, kept, schema = extended(docs, "n_tokens long, token_ids binary")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(*shared.value, pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in chunks(texts, 1_000_000):
                part = batch.slice(a, b - a)
                ids = encoder.encode(texts[a:b])
                n = pa.array([len(x) // 4 for x in ids], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n, pa.array(ids, type=pa.binary())], names=[*kept, "n_tokens", "token_ids"])

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """`encoded` plus decoded (binary): the bytes of the tokens in token_ids. A null list decodes as empty."""
    tokens = read_ranks(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    rows, kept, schema = extended(encoded, "decoded binary")
    at = kept.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [b"".join(map(get, np.frombuffer(x, dtype="<u4").tolist())) for x in as_bytes(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, type=pa.binary())], names=[*kept, "decoded"])

    return rows.mapInArrow(run, schema)
