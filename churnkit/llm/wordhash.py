"""Vectorised word and shingle hashing over whole batches of texts (numpy, used inside Spark tasks).

A batch of texts is laid out as one byte array; word boundaries, 64-bit word hashes and
5-word shingle hashes of all documents come out of a handful of array passes, so the cost is a
few nanoseconds per byte and memory is a fixed multiple of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers over the whole range (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: one random-looking 64-bit code per byte value, and the odd multiplier of the positional powers
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
POWER = np.uint64(0xD6E8FEB86659FD93)


INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per process up to the longest batch seen."""
    have = _TABLES.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _TABLES[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def byte_class(chars: bytes) -> np.ndarray:
    """Lookup table: True for the bytes that belong to words, given the separator bytes."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = False
    return table


#: words are runs of anything but ASCII white space (space, \t \n \v \f \r)
SPACE_SEPARATED = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def to_bytes(texts) -> list[bytes]:
    """UTF-8 bytes of each text; a missing text is empty."""
    return [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def word_spans(raw: list[bytes], table: np.ndarray = SPACE_SEPARATED, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the batch, A-Z lower-cased if asked, word starts, word ends, number of words of each text)."""
    sep = b" " if not table[32] else b"\x00"
    data = np.frombuffer(sep.join(raw) + sep, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = table[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([np.zeros(1, dtype=edge.dtype), edge])
    starts, ends = edge[0::2], edge[1::2]
    stops = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    upto = np.searchsorted(starts, stops)
    return data, starts, ends, np.diff(upto, prepend=0)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of the batch: differences of one running sum of byte codes times
    positional powers, shifted back to the word's start (the power is odd, so it has an inverse)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * _powers(POWER, len(data)), out=running[1:])
    total = (running[ends] - running[starts]) * _powers(INVERSE, len(data) + 1)[starts]
    return mix64(total + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word grams, text by text, and their number per text.

    A text with fewer than k words has its whole word sequence as its one gram; a text without
    words has none.
    """
    n = len(words)
    full = np.maximum(counts - k + 1, 0)
    first = np.cumsum(counts) - counts
    short = (counts > 0) & (counts < k)
    grams = full + short
    out = np.empty(int(grams.sum()), dtype=np.uint64)
    put = np.cumsum(grams) - grams
    if full.any():
        m = n - k + 1
        total = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            total = total * POWER + words[j:j + m]
        at = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
        out[np.repeat(put, full) + at] = total[np.repeat(first, full) + at]
    for i in np.flatnonzero(short):
        h = 0
        for w in words[first[i]:first[i] + counts[i]]:
            h = (h * int(POWER) + int(w)) & MASK
        out[put[i]] = (h ^ (int(counts[i]) * 0x9E3779B97F4A7C15)) & MASK
    return mix64(out), grams


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct values of each text in turn."""
    at = 0
    for n in counts:
        own = np.sort(values[at:at + n])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if n else own
        at += n


def chunks(raw: list, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of a batch of texts of about `size` bytes (characters) each, or one text more."""
    at = total = 0
    for i, r in enumerate(raw):
        total += len(r) + 1
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(raw):
        yield at, len(raw)


def shingle_sets(texts, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text (str, bytes or None) of a batch."""
    raw = to_bytes(texts)
    for i, j in chunks(raw):
        data, starts, ends, counts = word_spans(raw[i:j])
        grams, per_text = gram_hashes(word_hashes(data, starts, ends), counts, k)
        yield from distinct_sets(grams, per_text)
