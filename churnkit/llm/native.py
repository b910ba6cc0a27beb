"""Column helpers of the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: code points that stand for marks inside a text; those a text holds itself are replaced first
OPEN, CLOSE, DASH, DOT = "\uE000", "\uE001", "\uE002", "\uE003"

MATCHES = "array<struct<start:int,end:int,value:string,before:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often (or inside which lambda) it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without_marks(text: Column) -> Column:
    """The text with the mark code points replaced, one for one, by U+FFFD."""
    marks = OPEN + CLOSE + DASH + DOT
    held = F.contains(text, F.lit(OPEN))
    for m in marks[1:]:
        held = held | F.contains(text, F.lit(m))
    return F.when(held, F.translate(text, marks, "\uFFFD" * len(marks))).otherwise(text)


def prefix_sums(sizes: Column, block: int = 256) -> Column:
    """Exclusive running sums of a non-empty array<int>, block by block, so long arrays stay cheap."""
    def grow(first: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return let(grow(F.lit(0), totals), lambda at: F.flatten(F.transform(blocks, lambda b, j: F.slice(grow(F.element_at(at, j + 1), b), 1, F.size(b)))))

    def of_sizes(all_sizes: Column) -> Column:
        last = F.floor((F.size(all_sizes) - 1) / F.lit(block)).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(all_sizes, j * block + 1, block)), of_blocks)

    return let(sizes, of_sizes)


def matches(text: Column, pattern: str, before: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping matches, in code points, end exclusive.

    `before` of a match is this function of the text from the match before it (included) up to it. `text` must
    be free of marks: the matches are bracketed by marks in one pass and the pieces between marks are measured.
    """
    def found(pieces: Column, at: Column) -> Column:
        def one(i: Column) -> Column:
            start, value = F.element_at(at, i), F.element_at(pieces, i)
            earlier = F.lit("")
            if before:
                earlier = before(F.concat(F.when(i > 2, F.element_at(pieces, F.greatest(i - 2, F.lit(1)))).otherwise(F.lit("")), F.element_at(pieces, i - 1)))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), earlier.alias("before"))
        return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2)), one)).otherwise(F.array().cast(MATCHES))

    split = F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]", -1)
    return let(split, lambda pieces: let(prefix_sums(F.transform(pieces, lambda x: F.length(x))), lambda at: found(pieces, at)))
