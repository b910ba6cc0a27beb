"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers by pattern and check.
They are the seed entities. Every token that holds a digit or an at sign is an instance; the word before it
and the token's written form are its lexical pattern. Patterns and instances make a bipartite graph:
a pattern is worth the share of known entities of a kind among the instances it occurs with, an
instance is worth the mean of its patterns, and both are scored in turns by grouped sums. Instances
that reach ACCEPT through patterns with enough seeds are new spans of that kind; base spans stay.

Only tokens with digits or at signs leave the scan (as hashes, places and short forms), so what is
shuffled is a small part of the text, and hot patterns are pre-aggregated before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit.llm.native import DASH, DOT, MATCHES, let, matches, without_marks
from churnkit.llm.tables import stage_table

KINDS = ["email", "ip", "card", "phone"]
#: turns of scoring, seeds that count as doubt against a pattern, least score of a new instance
TURNS, DOUBT, ACCEPT = 3, 2.0, 0.8

#: The patterns of the contract, in forms that cost linear time and no recursion: a run is entered
#: only at its start (or where the last match ended), and separators inside a run are one mark each.
EMAIL = rf"(?:(?<![A-Za-z0-9._%+\-{DOT}])|\G)[A-Za-z0-9._%+\-{DOT}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = rf"[0-9][0-9{DASH}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: the last word of a text (words are entered at their starts only: linear time)
LAST_WORD = r"(?<!\S)(\S++)\s*+$"

def _none() -> Column:
    return F.array().cast(MATCHES)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits of a string pass the Luhn check."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    terms = F.transform(F.split(F.reverse(digits), "", -1), lambda c, i: F.when(c == "", F.lit(0)).otherwise(term(c, i)))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def _byte_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255)


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind>> of base spans in order of start, then kind as listed; `text` not null, free of marks."""
    digits = F.regexp_like(text, F.lit("[0-9]"))
    emails = F.when(F.contains(text, F.lit("@")), matches(F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT), EMAIL)).otherwise(_none())
    ips = F.when(digits, F.filter(matches(text, IP), lambda m: _byte_parts(m["value"]))).otherwise(_none())
    runs = F.when(digits, matches(F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", DASH), CARD)).otherwise(_none())
    cards = F.filter(runs, lambda m: let(_digits(m["value"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)))
    phones = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda m: F.length(_digits(m["value"])).between(10, 15))).otherwise(_none())

    def of_kind(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.concat(*[of_kind(found, kind) for kind, found in enumerate([emails, ips, cards, phones])]))


def tokens(text: Column) -> Column:
    """array<struct<start, end, form, code, before>> of the tokens with a digit or at sign.

    Punctuation at the token's ends isn't part of it. `form` has 9 for each digit and one a for a run
    of letters; `before` is the lower-cased word before the token (its form if it has digits).
    """
    trimmed = r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9]+$"

    def form(value: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a")

    def one(m: Column) -> Column:
        lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"^[^A-Za-z0-9+(]+", ""))
        value = F.regexp_replace(m["value"], trimmed, "")
        near = F.lower(m["before"])
        return F.struct((m["start"] + lead).alias("start"), (m["start"] + lead + F.length(value)).alias("end"), form(value).alias("form"),
                        F.xxhash64(value).alias("code"), F.when(F.regexp_like(near, F.lit("[0-9]")), form(near)).otherwise(near).alias("before"))

    found = F.transform(matches(text, TOKEN, lambda earlier: F.regexp_extract(earlier, LAST_WORD, 1)), one)
    return F.filter(found, lambda t: t["end"] > t["start"])


def _with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_code, base, tokens, kinds): base spans, and tokens with the kind of the base span each overlaps."""
    text = without_marks(F.coalesce(F.col("text"), F.lit("")))
    marked = F.regexp_like(F.col("clean"), F.lit("[0-9@]"))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_code"), text.alias("clean")).select(
        "doc_id", "text_code",
        F.when(marked, base_spans(F.col("clean"))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("base"),
        F.when(marked, tokens(F.col("clean"))).alias("tokens"))
    return stage_table(found, "pii")


def _edges(found: DataFrame) -> DataFrame:
    """One row per instance occurrence: doc_id, text_code, start, end, pattern, code, kind (of an overlapping base span or null)."""
    rows = found.filter(F.size("tokens") > 0).select("doc_id", "text_code", "base", F.explode("tokens").alias("t"))
    over = F.filter("base", lambda b: (b["start"] < F.col("t.end")) & (b["end"] > F.col("t.start")))
    return rows.select("doc_id", "text_code", "t.start", "t.end", F.xxhash64("t.before", "t.form").alias("pattern"), "t.code", F.get(over, F.lit(0))["kind"].alias("kind"))


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, text_code, start, kind, end): new spans, from scoring the pattern-instance graph in turns."""
    edges = stage_table(_edges(found), "pii_edges")
    graph = stage_table(edges.groupBy("pattern", "code").agg(F.count("*").alias("n"), F.count("kind").alias("seeds"), F.min("kind").alias("kind")), "pii_graph")
    # seeds: instances that are base spans wherever they occur
    known = graph.filter("seeds > 0").groupBy("code").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("worth"), F.lit(True).alias("seed"))
    unknown = graph.filter("seeds = 0").join(known, "code", "left_anti").select("pattern", "code", "n")
    worth = known.select("code", "kind", "worth")
    degree = graph.groupBy("pattern").agg(F.countDistinct("code").alias("degree"))
    pairs = graph.select("pattern", "code")
    for _ in range(TURNS):
        patterns = (pairs.join(worth, "code").groupBy("pattern", "kind").agg(F.sum("worth").alias("total"))
                    .join(degree, "pattern").select("pattern", "kind", (F.col("total") / (F.col("degree") + DOUBT)).alias("trust")))
        by_pattern = unknown.join(patterns, "pattern")
        places = unknown.groupBy("code").agg(F.count("*").alias("patterns"))
        scored = by_pattern.groupBy("code", "kind").agg(F.sum("trust").alias("total")).join(places, "code").select("code", "kind", (F.col("total") / F.col("patterns")).alias("worth"))
        worth = stage_table(known.select("code", "kind", "worth").unionByName(scored), "pii_worth")
    best = (worth.join(known.select("code"), "code", "left_anti").filter(F.col("worth") >= ACCEPT)
            .groupBy("code").agg(F.max(F.struct("worth", (-F.col("kind")).alias("order"))).alias("best")).select("code", (-F.col("best.order")).alias("kind")))
    return edges.filter("kind is null").drop("kind").join(best, "code").select("doc_id", "text_code", "start", "kind", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, text_code, base and spans.

    `base` holds the base spans, `spans` these and the discovered ones: arrays of struct<start, kind,
    end> in code points, ordered by start, then kind (index in KINDS), then end. A null or empty text
    has none. Rows with equal doc_id and text get equal spans; tables without tokens or without rows
    give empty spans or no rows. Columns of `docs` besides doc_id and text aren't read.
    """
    found = _with_spans(docs.select("doc_id", "text"))
    new = (discovered(found).distinct().groupBy("doc_id", "text_code").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
           .select(F.col("doc_id").alias("new_doc"), F.col("text_code").alias("new_code"), "new"))
    rows = found.select("doc_id", "text_code", "base")
    rows = rows.join(new, rows["doc_id"].eqNullSafe(new["new_doc"]) & (rows["text_code"] == new["new_code"]), "left")
    return rows.select("doc_id", "text_code", "base", F.when(F.col("new").isNotNull(), F.sort_array(F.concat("base", "new"))).otherwise(F.col("base")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    """Number of spans of a kind (index in KINDS)."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets ([EMAIL], ...), all rows and columns kept.

    Overlapping spans are one, named after the first. If there is a column n_chars, it gets the new
    length of changed texts. A null text stays null.
    """
    found = personal_data(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("doc"), F.col("text_code").alias("code"), "spans").dropDuplicates(["doc", "code"])
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.when(fresh, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    cleaned = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    # the row travels as one value, so that no name of its columns can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("own_code"))
    rows = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc")) & (F.col("own_code") == F.col("code")), "left")
    rows = rows.select("row", "spans", F.when(F.col("spans").isNotNull(), cleaned).otherwise(text).alias("new"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("new").alias(c)
        if c == "n_chars":
            return F.when(F.col("spans").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return rows.select(*[column(c) for c in docs.columns])
