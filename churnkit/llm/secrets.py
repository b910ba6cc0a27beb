"""Secret scans: base patterns, and password guess cost of values in credential contexts.

Base spans follow the patterns of the contract. Besides, values that stand in a credential context (a
credential word, then `:`, `=`, "is" or a space, then a run of value characters; contexts may overlap, as
in "auth password: ...") are judged by how many guesses they would take: dynamic programming finds the cheapest
segmentation of the value into dictionary words, dates, repeats, keyboard walks, sequences and brute-force spans;
the cost is the sum of the segments' log10 guesses plus a price per further segment. Values that cost GUESSES (log10)
or more are secrets and become spans of kind `value`; words, dates and walks stay out. After `:` or `=` any value
is judged; after "is" or a mere space, where ordinary prose goes on, the credential word must be a whole word
and the value must hold a digit.

All contexts of one run of value characters end where the run ends, so one search, right to left, gives the cost of
each of them: a text costs time in proportion to its length, however many credential words a run holds.

Every text is scanned whole inside Spark tasks; nothing is shuffled.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.tables import extended

KINDS = ["assign", "access", "hex", "value"]
#: least log10 of the guesses of a secret value
GUESSES = 8.0
#: price of each further segment (log10)
JOINT = 0.5

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: credential words; fixed values
NAMES = "pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?|bearer|pin"
#: a value's first six characters after a sign, or (second group) after "is" or a space
CREDENTIAL = re.compile(rf"""(?=(?:{NAMES})["']?\x20*[:=]\x20*["']?([!-&(-~]{{6}}))|(?<![a-z0-9])(?=(?:{NAMES})["']?(?:\x20is\x20|\x20)["']?([!-&(-~]{{6}}))""",
                        re.IGNORECASE | re.ASCII)
RUN = re.compile(r"[!-&(-~]{6,}")
MARKS = "\"',;.)]}>"

#: fixed values: words that guessers try first, by rank
COMMON = ("password 123456 qwerty admin welcome letmein login master hello dragon monkey shadow sunshine princess football baseball superman "
          "michael jordan secret pass test user root guest default changeme temp demo access system server computer internet summer winter spring autumn "
          "love trust iloveyou flower cheese freedom whatever killer pepper ginger cookie summer cherry orange banana apple house horse battery staple correct "
          "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
          "the and for you that with this have from they will would there their what about which when make like time just know people into year your good "
          "some could them see other than then now look only come over think also back after use two how our work first well way even new want because any "
          "these give day most key token value example sample string null none true false your_password xxxxxx placeholder dummy foo bar baz").split()
#: fixed values: keyboard rows
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@!", "aeoistsai")



class Words:
    """Ranks of the words guessers try: the common ones, then the words and word parts of a public vocabulary.

    `longest` gives, by the first three letters, the length of the longest word that begins with them; `backwards` the
    same for words read from the right.
    """

    def __init__(self, vocabulary: str):
        self.rank: dict[str, int] = {}
        for r, w in enumerate(COMMON, 1):
            self.rank.setdefault(w, r)
        with open(vocabulary, "rb") as lines:
            for line in lines:
                part = base64.b64decode(line.split()[0]).removeprefix(b" ")
                if len(part) >= 4 and part.isalpha():
                    self.rank.setdefault(part.decode().lower(), len(self.rank) + 1)
        self.most = max(map(len, self.rank))
        self.longest: dict[str, int] = {}
        self.backwards: dict[str, int] = {}
        for w in self.rank:
            for table, head in ((self.longest, w[:3]), (self.backwards, w[-3:][::-1])):
                table[head] = max(table.get(head, 0), len(w))


_WORDS: list[Words] = []


def words() -> Words:
    """The words of this process: those that `scan` sent with its task, else the public vocabulary's."""
    if not _WORDS:
        _WORDS.append(Words(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return _WORDS[0]


NEAR = {}
for _y, _row in enumerate(ROWS):
    for _x, _c in enumerate(_row):
        NEAR[_c] = (_y, _x)
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d)")


def _word_cost(s: str) -> float | None:
    low, rank = s.lower(), words().rank
    for form, price in ((low, 0.0), (low.translate(LEET), 0.5), (low[::-1], 0.3)):
        if form in rank:
            case = 0.0 if s == low else 0.3 if s[1:] == low[1:] or s == s.upper() else min(len(s), 10) * 0.3
            return math.log10(rank[form] + 1) + price + case
    return None


#: log10 of the alphabet of each set of character classes (digits, lower, upper, others)
ALPHABET = [math.log10(max(10, 10 * (m & 1) + 26 * (m >> 1 & 1) + 26 * (m >> 2 & 1) + 33 * (m >> 3))) for m in range(16)]


#: the sets that hold each class, with their prices
HOLDING = {k: [(m, ALPHABET[m]) for m in range(16) if m & k] for k in (1, 2, 4, 8)}


def _class(c: str) -> int:
    return 1 if c.isdigit() else 2 if "a" <= c <= "z" else 4 if "A" <= c <= "Z" else 8


def _brute(s: str) -> float:
    mask = 0
    for c in s:
        mask |= _class(c)
    return len(s) * ALPHABET[mask]


def _known(s: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words and dates in `s`."""
    n = len(s)
    low = s.lower()
    leet = low.translate(LEET)
    known = words()
    found = []
    for i in range(n - 2):
        reach = max(known.longest.get(low[i:i + 3], 0), known.longest.get(leet[i:i + 3], 0), known.backwards.get(low[i:i + 3], 0))
        for j in range(i + 3, min(n, i + reach) + 1):
            c = _word_cost(s[i:j])
            if c is not None:
                found.append((i, j, c))
        m = DATE.match(s, i) if s[i].isdigit() else None
        if m and m.end() - i >= 4:
            found.append((i, m.end(), 2.1 if m.end() - i == 4 else 4.6))
    return found


def _alike(s: str, i: int, j: int, most: int) -> int:
    """Characters, `most` at most, that `s` has alike from i and from j on (i < j); slices double, then halve."""
    most = min(most, len(s) - j)
    k, w = 0, 1
    while k + w <= most and s[i + k:i + k + w] == s[j + k:j + k + w]:
        k += w
        w *= 2
    while w:
        if k + w <= most and s[i + k:i + k + w] == s[j + k:j + k + w]:
            k += w
        w //= 2
    return k


def repeats(s: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal repeats: stretches of two periods or more that no neighbour continues.

    A repeat's period is the length of the longest Lyndon word at some place, in one of the two orders of
    characters; the words follow from comparing suffixes, right to left. What is alike at a distance is kept for
    the next place, so long repeats are compared once.
    """
    n = len(s)
    back = s[::-1]
    found = set()
    for sign in (1, -1):
        ends = [n] * n
        alike: dict[int, tuple[int, int]] = {}   # by distance: the last place, and where likeness from there on ends
        seen: dict[int, int] = {}                # by period: the start of the last repeat
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                p = j - i
                place, end = alike.get(p, (n, i))
                k = _alike(s, i, j, place - i)
                if k == place - i:
                    k = end - i
                alike[p] = (i, i + k)
                if j + k == n or (s[j + k] < s[i + k]) == (sign > 0):
                    if k and seen.get(p, n) > i:
                        left = _alike(back, n - j, n - i, n)
                        if left + p + k >= 2 * p:
                            found.add((i - left, j + k, p))
                            seen[p] = i - left
                    break
                j = ends[j]
            ends[i] = j
    return sorted(found)


class _Repeat:
    """Segments of a whole number of units inside one repeat, by their ends; a unit costs its word or brute force."""

    def __init__(self, start: int, end: int, units: list[float]) -> None:
        self.start, self.end, self.units = start, end, units
        self.size = len(units)
        self.least = 3 if self.size == 1 else 2 * self.size
        self.open: dict[int, list[tuple[int, float]]] = {}

    def mirrored(self, n: int) -> _Repeat:
        """The same repeat of the text read from the right."""
        return _Repeat(n - self.end, n - self.start, [self.units[(n - i) % self.size] for i in range(self.size)])

    def cheapest(self, j: int, before: list[float]) -> float:
        a = j - self.least
        starts = self.open.setdefault(j % self.size, [])
        starts.append((a, before[a] + self.units[a % self.size]))
        return _cheapest(starts, lambda i: math.log10((j - i) // self.size))


def _repeats(value: str) -> list[_Repeat]:
    """The repeats of a value, with units of one or several periods (several only where a word makes them cheaper)."""
    found, longest = [], words().most
    for start, end, period in repeats(value):
        for size in range(period, max(period, min(longest, (end - start) // 2)) + 1, period):
            if end - start < (3 if size == 1 else 2 * size):
                continue
            brute = _brute(value[start:start + size])
            units = [brute] * size
            if size <= longest:
                for i in range(start, start + size):
                    word = _word_cost(value[i:i + size])
                    if word is not None:
                        units[i % size] = min(brute, word)
            if size == period or min(units) < brute:
                found.append(_Repeat(start, end, units))
    return found


def _cheapest(starts: list[tuple[int, float]], price) -> float:
    """Least cost of a segment from one of `starts` (place, cost up to there) on; starts that can't win any more are dropped.

    `price` grows ever slower with the length, so a start that costs no less than an earlier one never will.
    """
    least, kept = math.inf, []
    for i, c in starts:
        total = c + price(i)
        if total < least:
            least = total
            kept.append((i, c))
    starts[:] = kept
    return least


def _next_to(a: str, b: str, step: int | None) -> bool:
    if step is not None:
        return ord(b) - ord(a) == step and a.isalnum() and b.isalnum()
    if a not in NEAR or b not in NEAR or a == b:
        return False
    (y, x), (v, u) = NEAR[a], NEAR[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1


def _prefix_costs(value: str, known: list[tuple[int, int, float]], stretches: list[_Repeat]) -> list[float]:
    """log10 of the guesses of each prefix of a value (its cheapest segmentation), one search over the whole value."""
    n = len(value)
    low = value.lower()
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, c in known:
        ends.setdefault(j, []).append((i, c))
    begin: dict[int, list[_Repeat]] = {}
    for r in stretches:
        begin.setdefault(r.start + r.least, []).append(r)
    active: list[_Repeat] = []
    chains = [[None, 0, [], lambda k: 2.0 + 0.5 * k ** 0.5 + math.log10(k)], [1, 0, [], lambda k: 1.3 + math.log10(k)], [-1, 0, [], lambda k: 1.3 + math.log10(k)]]
    out = [0.0]
    before = [0.0]            # cost up to each place, with the price of a further segment
    brute = [math.inf] * 16   # the last segment is brute force over this set of classes
    for j in range(1, n + 1):
        least = math.inf
        for m in range(16):
            if not m & _class(value[j - 1]):
                brute[m] = math.inf
        for m, price in HOLDING[_class(value[j - 1])]:
            brute[m] = min(brute[m], before[j - 1]) + price
            least = min(least, brute[m])
        for i, c in ends.get(j, ()):
            least = min(least, before[i] + c)
        for chain in chains:
            step, start, starts, price = chain
            if j > 1 and not _next_to(low[j - 2], low[j - 1], step):
                chain[1], chain[2] = j - 1, []
            elif j - start >= 3:
                starts.append((j - 3, before[j - 3]))
                least = min(least, _cheapest(starts, lambda i: price(j - i)))
        if active or j in begin:
            active = [r for r in active if r.end >= j] + begin.get(j, [])
            for r in active:
                least = min(least, r.cheapest(j, before))
        out.append(least)
        before.append(least + JOINT)
    return out


def guess_cost(value: str) -> float:
    """log10 of the guesses a value takes: its cheapest segmentation."""
    return _prefix_costs(value, _known(value), _repeats(value))[-1]


def suffix_costs(value: str) -> list[float]:
    """The guess costs of value[i:] for every i: one search over the value read from the right."""
    n = len(value)
    known = [(n - j, n - i, c) for i, j, c in _known(value)]
    return _prefix_costs(value[::-1], known, [r.mirrored(n) for r in _repeats(value)])[::-1]


def base_spans(text: str) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, kind, end, span of the value) of base matches in order of start, then kind."""
    out = [(m.start(), 0, m.end(), m.span(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end(), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.span()) for m in HEX.finditer(text)]
    return sorted(out)


def credential_values(text: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the values in credential contexts; quotes and closing marks are left off."""
    places = {}
    for m in CREDENTIAL.finditer(text):
        signed = m[1] is not None
        start = m.start(1) if signed else m.start(2)
        places[start] = places.get(start, False) or signed
    if not places:
        return []
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    begins = [a for a, _ in runs]
    of_run: dict[int, list[int]] = {}
    for start in sorted(places):
        of_run.setdefault(bisect_right(begins, start) - 1, []).append(start)
    found = []
    for r, starts in of_run.items():
        first, value = starts[0], text[starts[0]:runs[r][1]].rstrip(MARKS)
        end = first + len(value)
        digit = max((i for i in range(len(value) - 1, -1, -1) if value[i].isdigit()), default=-1) + first
        starts = [s for s in starts if end - s >= 6 and (places[s] or s <= digit)]
        if starts:
            first, value = starts[0], text[starts[0]:end]
            costs = suffix_costs(value)
            found += [(s, end, costs[s - first]) for s in starts]
    return found


def scan_text(text: str) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, log10 guesses of its value or None) of all spans of a text, by start, then kind."""
    base = base_spans(text)
    out = [(a, k, b, guess_cost(text[v[0]:v[1]]) if k == 0 else None) for a, k, b, v in base]
    out += [(a, 3, b, c) for a, b, c in credential_values(text) if c >= GUESSES]
    return sorted(out, key=lambda s: s[:3])


def scan(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`docs` plus secrets: array<struct<start, kind, end, guesses>> in code points, end exclusive.

    kind is the index in KINDS; `guesses` is the log10 guess cost of a value (null where none was judged).
    `vocabulary` is a rank file, read on the driver and broadcast (its size is fixed by the file). Null and empty texts
    have none. A column named secrets is replaced; all other columns and rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Words(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    added = "secrets array<struct<start:int,kind:int,end:int,guesses:double>>"
    rows, kept, schema = extended(docs, added)
    at = kept.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _WORDS[:] = [shared.value]
        for batch in batches:
            found = [[{"start": a, "kind": k, "end": b, "guesses": c} for a, k, b, c in scan_text(t)] if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=kind)], names=[*kept, "secrets"])

    return rows.mapInArrow(run, schema)
