"""Periodic runs of the words of a text, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Its last
square (two equal neighbours of q words) is *branching*: the words after the two halves differ. So both halves
are suffixes that share exactly q words, and the longest-common-prefix interval of depth q holds both, in
different children. Each boundary of an interval is looked at once: the suffixes of the smaller side look up,
in the inverse suffix array, whether the suffix `depth` words ahead or behind lies on the other side; no tree
node is built, and a text of n words costs n log n. Squares are then rotated to the left as far as they go and
merged into runs: of all squares that end and start alike the least period stays.

Texts are taken in pieces of about a million bytes. The words of different texts are different letters of one
alphabet and every text ends with a letter of its own, so one suffix array serves all texts of a piece and no
interval crosses texts. Nothing is shuffled; a text is handled whole, whatever its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.tables import as_bytes, extended
from churnkit.llm.wordhash import chunks

#: bytes of text that share one suffix array (a longer text has one of its own)
PIECE = 1_000_000
#: rows of (boundary, suffix) looked up at once
LOOKED_UP = 1_000_000


def suffix_array(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, inverse, common prefix lengths of neighbours) of letters >= 0.

    The last letter must occur once. By prefix doubling; only suffixes that still tie are sorted again, so
    ordinary prose takes few rounds. `prefix[k]` is that of the suffixes at k - 1 and k.
    """
    n = len(letters)
    sa = np.argsort(letters, kind="stable")
    ordered = letters[sa]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.repeat(first, size)
    levels = [rank.astype(np.int32 if n < 2**31 else np.int64)]  # ranks by the first 1, 2, 4, ... letters
    prefix = np.zeros(n + 1, dtype=np.int64)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    h = 1
    while len(tied):
        at = sa[tied]
        one, two = rank[at], rank[at + h]
        order = np.lexsort((two, one))
        at, one, two = at[order], one[order], two[order]
        sa[tied] = at
        same = one[1:] == one[:-1]
        fresh = np.r_[True, ~same | (two[1:] != two[:-1])]
        first = np.flatnonzero(fresh)
        size = np.diff(np.r_[first, len(at)])
        rank[at] = np.repeat(tied[first], size)
        split = 1 + np.flatnonzero(same & fresh[1:])
        x, y = at[split - 1] + h, at[split] + h
        shared = np.full(len(split), h, dtype=np.int64)
        for j in range(len(levels) - 1, -1, -1):
            equal = levels[j][x] == levels[j][y]
            step = np.where(equal, 1 << j, 0)
            x, y, shared = x + step, y + step, shared + step
        prefix[tied[split]] = shared
        tied = tied[np.repeat(size > 1, size)]
        levels.append(rank.astype(levels[0].dtype))
        h *= 2
    return sa, rank, prefix


def _nearest(prefix: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each boundary in `at` (ascending): the nearest one before (step -1) with a smaller prefix, or after (step 1)
    with one that is not larger. Pointers jump over pointers; what a few rounds leave is followed one by one."""
    near = np.zeros(len(prefix), dtype=np.int64)
    near[at] = at + step
    left = at

    def passed(p, k):
        return prefix[p] >= prefix[k] if step < 0 else prefix[p] > prefix[k]

    for _ in range(32):
        left = left[passed(near[left], left)]
        if not len(left):
            return near[at]
        near[left] = near[near[left]]
    for k in left[::-step].tolist():
        p = int(near[k])
        while passed(p, k):
            p = int(near[p])
        near[k] = p
    return near[at]


def branching_squares(sa: np.ndarray, isa: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, periods) of all squares whose two halves are followed by different letters, in blocks."""
    n = len(sa)
    at = np.flatnonzero(prefix[:n] > 0)
    if not len(at):
        return
    low, high = _nearest(prefix, at, -1), _nearest(prefix, at, 1)
    left = at - low <= high - at                       # the smaller side of a boundary: [low, at) or [at, high)
    begin, width = np.where(left, low, at), np.where(left, at - low, high - at)
    other, stop = np.where(left, at, low), np.where(left, high, at)
    depth = prefix[at]
    ends = np.cumsum(width)
    cuts = np.searchsorted(ends, np.arange(LOOKED_UP, ends[-1] + LOOKED_UP, LOOKED_UP))
    a = 0
    for b in np.minimum(cuts + 1, len(at)).tolist():
        if b <= a:
            continue
        w = width[a:b]
        inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        suffix = sa[np.repeat(begin[a:b], w) + inside]
        d, lo, hi = np.repeat(depth[a:b], w), np.repeat(other[a:b], w), np.repeat(stop[a:b], w)
        ahead, behind = suffix + d, suffix - d
        slot = isa[np.minimum(ahead, n - 1)]
        held = (ahead < n) & (slot >= lo) & (slot < hi)
        yield suffix[held], d[held]
        slot = isa[np.maximum(behind, 0)]
        held = (behind >= 0) & (slot >= lo) & (slot < hi)
        yield behind[held], d[held]
        a = b


def rotated(letters: np.ndarray, start: int, period: int) -> int:
    """First letter of the stretch of this period that holds the square at `start`."""
    block = 64
    while start:
        m = min(block, start)
        differ = np.flatnonzero(letters[start - m:start] != letters[start - m + period:start + period])
        if len(differ):
            return start - m + int(differ[-1]) + 1
        start -= m
        block *= 2
    return start


def find_runs(letters: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of length >= max(least, exponent * period), exponent >= 2, by start, period."""
    squares = []
    for start, period in branching_squares(*suffix_array(letters)):
        first = start + 2 * period - np.maximum(least, exponent * period)   # a run starts here or before
        inside = first >= 0
        start, period, first = start[inside], period[inside], first[inside]
        held = letters[first] == letters[first + period]
        squares += zip((start + 2 * period)[held].tolist(), period[held].tolist())
    runs, ends = [], defaultdict(list)
    for end, q in sorted(squares):
        # a multiple of a run's period gives the same stretch
        if any(not q % p and s <= end - 2 * q for s, p in ends[end]):
            continue
        s = rotated(letters, end - 2 * q, q)
        if end - s >= max(least, exponent * q):
            ends[end].append((s, q))
            runs.append((s, end - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[bytes], least: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, text without the repetitions) of each text."""
    for a, b in chunks(texts, PIECE):
        words = [t.split() for t in texts[a:b]]        # splits at the bytes 20 and 09-0D
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = defaultdict(count().__next__)
        total = int(sizes.sum()) + len(words)
        letters = np.empty(total, dtype=np.int64)
        stops = np.cumsum(sizes + 1)
        starts = stops - sizes - 1
        for w, s in zip(words, starts.tolist()):
            letters[s:s + len(w)] = [code[x] for x in w]
        letters[stops - 1] = len(code)
        letters += np.repeat(np.arange(len(words)), sizes + 1) * (len(code) + 1)
        found = find_runs(letters, least, exponent) if total else []
        of_text = defaultdict(list)
        for (s, n, q), i in zip(found, np.searchsorted(stops, [r[0] for r in found], side="right").tolist()):
            of_text[i].append((s - int(starts[i]), n, q))
        for i, w in enumerate(words):
            runs = of_text.get(i, [])
            if runs:
                cover = np.zeros(len(w) + 1, dtype=np.int64)
                for s, n, q in runs:
                    cover[s + q] += 1
                    cover[s + n] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                w = [x for x, k in zip(w, keep.tolist()) if k]
            yield int(sizes[i]), runs, b" ".join(w)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """`docs` plus n_words (long), runs (array of start, length, period, by start, then period) and collapsed (string).

    Words are what lies between the characters 20 and 09-0D; they are numbered from 0. A run is a stretch of
    smallest period q and at least max(`least`, `exponent` * q) words (`exponent` >= 2) that no neighbouring word
    extends. `collapsed` has the words, joined by one space, without those that a run holds after its first q.
    A null text and one without words have no runs and collapse to an empty text; every row is judged alone, so
    repeated rows and missing ids change nothing. Columns named n_words, runs or collapsed are replaced, all other
    columns and every row are kept.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    rows, kept, schema = extended(docs, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                found = list(runs_of_texts(as_bytes(part.column(at)), least, exponent))
                flat = [r for _, runs, _ in found for r in runs]
                offsets = np.cumsum([0] + [len(runs) for _, runs, _ in found])
                fields = [pa.array([r[i] for r in flat], type=pa.int64()) for i in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([n for n, _, _ in found], type=pa.int64()), listed,
                                                  pa.array([c for _, _, c in found], type=pa.binary()).cast(pa.string())], names=[*kept, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)
