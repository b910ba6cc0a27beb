"""Document fingerprints by order MinHash, in DataFrame functions only.

A text is a list of tokens (white space parts them, long runs are cut every TOKEN_CHARS characters).
Its k-mers are GRAM consecutive tokens, numbered by occurrence, so repeats count. One hash deals the
numbered k-mers into BINS bins; in each bin the TUPLE smallest ones are selected, put in the order
of the text, and hashed as a tuple. The signature is the list of bins' tuple hashes. Texts that share
k-mers in the same order share tuples; moved, repeated or replaced passages change them, so the
share of equal tuples follows edit distance rather than bare set overlap.

To bound the work per text, bins are dealt from the k-mers whose own hash is among the KEPT smallest
distinct ones, a choice that depends on content only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm.native import let

TOKEN_CHARS, GRAM, KEPT, BINS, TUPLE = 16, 3, 128, 32, 2
#: rows of one id range (they are sorted together), and ranges at most
RANGE_ROWS, RANGES = 1000, 1 << 16

_BITS = 40


def _grams(text: Column) -> Column:
    """array<bigint> of hashes of the k-mers in text order; fewer than GRAM tokens are one k-mer."""
    tokens = F.regexp_extract_all(text, F.lit(rf"\S{{1,{TOKEN_CHARS}}}"), F.lit(0))

    def of(t: Column) -> Column:
        last = F.greatest(F.size(t) - GRAM, F.lit(0))
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(t, i + 1, GRAM)))).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, of)


def signature(text: Column) -> Column:
    """array<bigint>: one number per filled bin, the bin in the top bits and the tuple's hash below; ascending."""

    def numbered(found: Column) -> Column:
        """(code, place) in order of code, place -> (code of the numbered k-mer, place)."""
        def runs(own: Column) -> Column:
            first = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (F.element_at(own, i)["code"] != F.element_at(own, F.greatest(i - 1, F.lit(1)))["code"]))
            return let(first, lambda f: F.flatten(F.transform(f, lambda a, k: F.transform(
                F.slice(own, a, F.coalesce(F.get(f, k + 1), F.size(own) + 1) - a),
                lambda x, n: F.struct(F.xxhash64(x["code"], n).alias("code"), x["place"].alias("place"))))))
        return let(F.sort_array(found), runs)

    def selected(grams: Column) -> Column:
        def below(least: Column) -> Column:
            found = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("code"), i.alias("place"))), lambda x: x["code"] <= F.element_at(least, -1))
            once = lambda own: F.transform(own, lambda x: F.struct(F.xxhash64(x["code"], F.lit(0)).alias("code"), x["place"].alias("place")))
            return let(found, lambda own: F.when(F.size(own) == F.size(least), once(own)).otherwise(numbered(own)))
        return let(F.slice(F.sort_array(F.array_distinct(grams)), 1, KEPT), below)

    def bin_of(x: Column) -> Column:
        return F.shiftright(x["code"], 64 - int(math.log2(BINS)))

    def tuples(dealt: Column) -> Column:
        """Of each bin's run in `dealt` (ascending), the first TUPLE k-mers in text order, hashed."""
        first = F.filter(F.sequence(F.lit(1), F.size(dealt)), lambda i: (i == 1) | (bin_of(F.element_at(dealt, i)) != bin_of(F.element_at(dealt, F.greatest(i - 1, F.lit(1))))))

        def one(i: Column) -> Column:
            head = F.element_at(dealt, i)
            own = F.filter(F.slice(dealt, i, TUPLE), lambda x: bin_of(x) == bin_of(head))
            ordered = F.transform(F.sort_array(F.transform(own, lambda x: F.struct(x["place"].alias("place"), x["code"].alias("code")))), lambda x: x["code"])
            return F.shiftleft(bin_of(head) + BINS // 2, _BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(ordered), 64 - _BITS))

        return F.transform(first, one)

    return let(_grams(text), lambda grams: F.when(F.size(grams) > 0, let(F.sort_array(selected(grams)), tuples)).otherwise(F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either signature fills; 1 for two empty ones."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, _BITS))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled > 0, F.size(F.array_intersect(a, b)) / filled).otherwise(F.lit(1.0))


def as_text(signature_: Column) -> Column:
    """Signature as hexadecimal text."""
    return F.array_join(F.transform(signature_, lambda v: F.lpad(F.hex(v), 12, "0")), "")


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` (doc_id, text, ...) plus, as next_*, `columns` of the row that follows by (doc_id, text); the first follows the last.

    Ids are cut into ranges at approximate quantiles (at most RANGES of them; about RANGE_ROWS rows each up to
    then), each range is one window partition, and the first rows of a range also visit the range before
    it, so every row is shuffled once and no partition holds the whole order.
    """
    low = -(1 << 63)
    key = F.coalesce(F.col("doc_id"), F.lit(low))
    count = rows.count()
    wide = max(1, math.isqrt(min(RANGES, max(1, count // RANGE_ROWS))))
    at = rows.agg(F.percentile_approx(key, [i / (wide * wide) for i in range(wide * wide)], 20 * wide * wide).alias("at")).first()["at"] or [low]
    at = sorted({low, *at})
    outer = at[::wide]
    inner = F.array(*[F.array(*[F.lit(x) for x in at[i:i + wide]]) for i in range(0, len(at), wide)])
    upto = lambda arr, k: F.size(F.filter(arr, lambda s: s <= k))
    big = upto(F.array(*[F.lit(x) for x in outer]), F.col("_key"))
    small = let(big, lambda o: (o - 1) * wide + upto(F.element_at(inner, o), F.col("_key")))
    ranged = rows.withColumn("_key", key).withColumn("_range", small)

    firsts = rows.select(key.alias("_key")).withColumn("_range", small).groupBy("_range").agg(F.min("_key").alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_range")
    ends = firsts.select("_first", F.lag("_range").over(order).alias("_visits"), F.max("_range").over(Window.partitionBy(F.lit(0))).alias("_last"))
    ends = ends.select("_first", F.coalesce("_visits", "_last").alias("_visits"))

    ranged = ranged.join(F.broadcast(ends), F.col("_key") == F.col("_first"), "left")
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("visit"))
    visit = F.struct(F.col("_visits").alias("range"), F.lit(True).alias("visit"))
    ranged = ranged.withColumn("_at", F.explode(F.when(F.col("_visits").isNull(), F.array(own)).otherwise(F.array(own, visit))))
    ranged = ranged.withColumn("_range", F.col("_at.range")).withColumn("_visit", F.col("_at.visit"))
    window = Window.partitionBy("_range").orderBy("_visit", "_key", "text")
    out = ranged.select(*rows.columns, "_visit", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.filter(~F.col("_visit")).drop("_visit")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): text (null: empty) and its signature."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("signature", signature(F.col("text")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's.

    The edited text ends in the beginning of the next document, by ascending doc_id (rows that share an
    id by text, a null id first; the first follows the last): its last floor(n_chars / 4) code points are
    replaced by the next one's first as many (or all). Returns doc_id, n_chars (long), edited, signature,
    edited_signature, near_edited, near_next. Empty and null texts have an empty signature; two empty
    ones have likeness 1. A single row is its own next. Other columns of `docs` aren't read.
    """
    rows = with_next(fingerprints(docs), ["text", "signature"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_signature").withColumn("edited_signature", signature(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited", "signature", "edited_signature", likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                       likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
