"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are lower-cased words. Of every WINDOW consecutive hashes of GRAM words, the smallest (leftmost
among equals) is kept as a fingerprint with its place; GRAM + WINDOW - 1 = SPAN words, so any run of
SPAN words shared by a document and a benchmark item has the same fingerprint at the same place in
both, and none is missed. Fingerprints of documents and items are joined on the hash; each meeting
names an item and the shift between the two texts, and along that shift the words themselves are
compared (hits are extended to all windows that agree), so hash collisions can't add a hit.

An item with fewer than SPAN words is one window; grams of that many words are compared for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit.llm.native import let, lower_ascii
from churnkit.llm.tables import stage_table

SPAN, GRAM = 13, 8
WINDOW = SPAN - GRAM + 1
#: documents with hits, and bytes of their hits (item words included), that are broadcast at most (others join by shuffle)
BROADCAST_DOCS, BROADCAST_BYTES = 200_000, 64 << 20

#: words are runs of digits, letters and everything beyond ASCII
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """array<string> of the lower-cased words of a text; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1), "")


def _places(size: Column, span: int) -> Column:
    """0 .. size - span, empty if the text is shorter."""
    return F.when(size >= span, F.sequence(F.lit(0), size - span)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, short: list[int]) -> Column:
    """array<struct<span, code, place>>: winnowed grams, and all grams of the `short` lengths."""

    def grams(codes: Column, k: int) -> Column:
        return F.transform(_places(F.size(codes), k), lambda i: F.xxhash64(F.slice(codes, i + 1, k)))

    def pick(all_grams: Column) -> Column:
        lowest = F.transform(_places(F.size(all_grams), WINDOW), lambda i: let(
            F.slice(all_grams, i + 1, WINDOW), lambda own: i + F.array_position(own, F.array_min(own)).cast("int")))
        return F.transform(F.array_distinct(lowest), lambda p: F.struct(F.lit(SPAN).alias("span"), F.element_at(all_grams, p).alias("code"), (p - 1).alias("place")))

    def every(all_grams: Column, k: int) -> Column:
        return F.transform(all_grams, lambda c, i: F.struct(F.lit(k).alias("span"), c.alias("code"), i.alias("place")))

    def all_of(codes: Column) -> Column:
        parts = [let(grams(codes, GRAM), pick)] + [every(grams(codes, k), k) for k in short]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(F.transform(words, lambda w: F.xxhash64(w)), all_of)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): words that lie in a window of some item of `benchmark` (item_id, text).

    Returns doc_id, n_words, n_hit, n_items (long; items with occurring windows), items (array of
    their item_ids as sorted strings), contaminated (n_hit > 0 and 20 * n_hit >= n_words). Null and
    empty texts have no words; an empty benchmark leaves every document clean; repeated items (same
    item_id) count once; a null item_id counts as an item but has no entry in `items`. Rows that repeat
    a doc_id (or lack one) are judged row by row.
    """
    docs = docs.select("doc_id", "text")
    items = stage_table(benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0), "items")
    short = sorted(r.n for r in items.filter(F.size("item_words") < SPAN).select(F.size("item_words").alias("n")).distinct().collect())

    def exploded(df: DataFrame, words: Column, keep: list[str]) -> DataFrame:
        prints = df.select(*keep, F.explode(fingerprints(words, short)).alias("f"))
        return prints.select(*keep, "f.span", "f.code", "f.place")

    of_items = exploded(items, F.col("item_words"), ["item_id", "item_words"])
    # an item shorter than SPAN is compared by its own length only
    of_items = of_items.filter(F.col("span") == F.least(F.lit(SPAN), F.size("item_words"))).select("item_id", "item_words", "span", "code", F.col("place").alias("item_place"))
    of_docs = exploded(docs, words_of(F.col("text")), ["doc_id"])
    met = of_docs.join(of_items.select("span", "code", "item_id", "item_place", F.xxhash64("item_words").alias("which")), ["span", "code"])
    met = met.select("doc_id", "item_id", "which", "span", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    met = met.withColumn("which_item", F.struct(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "which"))
    texts = items.select(F.struct(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.xxhash64("item_words").alias("which")).alias("which_item"), "item_words").dropDuplicates(["which_item"])
    hits = stage_table(met.join(texts, "which_item").select(F.col("doc_id").alias("hit_doc"), "item_id", "item_words", "span", "shift"), "hits")
    per_doc = hits.groupBy("hit_doc").agg(F.collect_list(F.struct("item_id", "item_words", "span", "shift")).alias("hits"))
    # a word of a hit takes its bytes, rounded up to eight, and eight for its place
    of_hit = 64 + F.octet_length(F.array_join("item_words", "")) + 16 * F.size("item_words")
    size = hits.agg(F.coalesce(F.sum(of_hit.cast("long")), F.lit(0)).alias("bytes"), F.countDistinct("hit_doc").alias("d")).first()
    if size.bytes <= BROADCAST_BYTES and size.d <= BROADCAST_DOCS:
        per_doc = F.broadcast(per_doc)

    rows = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["hit_doc"]), "left").select("doc_id", words_of(F.col("text")).alias("words"), "hits")

    def windows(words: Column, hits: Column) -> Column:
        """array<struct<item_id, place, span>> of the windows that occur."""
        def along(x: Column) -> Column:
            first = F.greatest(F.lit(0), -x["shift"])
            last = F.least(F.size(x["item_words"]) - x["span"], F.size(words) - x["span"] - x["shift"])
            agree = F.when(first <= last, F.filter(F.sequence(first, last), lambda j: F.slice(words, x["shift"] + j + 1, x["span"]) == F.slice(x["item_words"], j + 1, x["span"])))
            return F.transform(F.coalesce(agree, F.array().cast("array<int>")), lambda j: F.struct(x["item_id"].alias("item_id"), (x["shift"] + j).alias("place"), x["span"].alias("span")))
        return F.flatten(F.transform(hits, along))

    found = rows.select("doc_id", F.size("words").cast("long").alias("n_words"),
                        F.when(F.col("hits").isNotNull(), let(F.col("words"), lambda w: windows(w, F.col("hits")))).alias("found"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["place"], x["place"] + x["span"] - 1)))))
    ids = F.array_distinct(F.transform("found", lambda x: x["item_id"]))
    out = found.select("doc_id", "n_words",
                       F.coalesce(F.when(F.size("found") > 0, covered), F.lit(0)).cast("long").alias("n_hit"),
                       F.coalesce(F.when(F.size("found") > 0, F.size(ids)), F.lit(0)).cast("long").alias("n_items"),
                       F.coalesce(F.sort_array(F.transform(ids, lambda x: x.cast("string"))), F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` whose document isn't contaminated; all columns. Of rows that share a doc_id, one
    contaminated text removes all (they are the same document); rows without an id are judged together."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
