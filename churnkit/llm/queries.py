"""Registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.llm.native import let

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SHINGLES_SQL = rf"""
words AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(s) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)"""


@query("op1_ngram_jaccard_join", f"WITH RECURSIVE {SHINGLES_SQL}\nSELECT doc_id, n AS n_shingles, min(r) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.ngram_join import ngram_components

    return ngram_components(read(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL can't merge byte pairs; tested against a plain merge loop and an exact round trip."""
    import public_tokenizers

    from churnkit.llm.byte_bpe import decode_documents, encode_documents

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    return (decode_documents(encoded.drop("text"), vocabulary)
            .select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model has no SQL; tested by held-out accuracy."""
    from churnkit.llm.labelled import fold
    from churnkit.llm.quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return (score_quality(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model has no SQL; tested by held-out accuracy."""
    from churnkit.llm.labelled import fold
    from churnkit.llm.toxicity import fit_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return (score_toxicity(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score")
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


WINDOWS_SQL = rf"""
doc_words AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS span, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM item_words, unnest(range(1, greatest(len(w) - 11, 2))) AS u(i) WHERE len(w) > 0),
found AS (
  SELECT d.doc_id, i, s.span, x.item_id FROM doc_words d, (SELECT DISTINCT span FROM item_windows) s, unnest(range(1, len(w) - s.span + 2)) AS u(i)
  JOIN item_windows x ON x.span = s.span AND x.g = array_to_string(d.w[i:i + s.span - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + span)) AS u(p) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)"""


@query("op3_decontamination", f"""WITH {WINDOWS_SQL}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.decontamination import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring in turns and matches without retries aren't SQL; base spans are tested against plain regular
    expressions, discovered ones against a brute-force scoring."""
    from churnkit.llm.pii import KINDS, count_of, listed, personal_data

    found = personal_data(read(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no xxHash of arrays; signatures are tested against a plain Python order MinHash."""
    from churnkit.llm.fingerprint import as_text, edited_fingerprints

    found = edited_fingerprints(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("signature")).alias("fingerprint"),
                        as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op4_chat_formatting", """WITH
t AS (
  SELECT conv_id, turn, replace(coalesce(nullif(role, ''), 'unknown'), '<|im_', '< |im_') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS body,
    CAST(floor(coalesce(turn, 0) / 64) AS BIGINT) AS part FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
v AS (
  SELECT t.conv_id, speaker, part, turn, role, body,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 11) OVER (
    PARTITION BY conv_id, speaker ORDER BY part, turn NULLS FIRST, role, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM v)
SELECT conv_id, speaker, part, count(*) AS n_turns, CAST(min(pos) AS BIGINT) AS start,
  string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text,
  coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(body) + 10 AS BIGINT) AS VARCHAR), ',' ORDER BY pos)
    FILTER (WHERE role = speaker), '') AS mask
FROM placed GROUP BY conv_id, speaker, part""")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnkit.llm.chat import rotated

    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return rotated(read(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash retrieval isn't SQL; tested against exact containment of every template in every text."""
    from churnkit.llm.licenses import scan

    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.round(x["contained"], 4).cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(listed, ",").alias("licenses"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches without retries and guess costs aren't SQL; tested against plain regular expressions and known costs."""
    from churnkit.llm.secrets import KINDS, scan

    names = F.array(*[F.lit(k) for k in KINDS])
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The text of one document in ten, by its id's checksum, repeats a stretch of its own words to the end."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(number / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(at, " "))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return docs.withColumn("text", F.when(number % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of every text by SQL would compare every word with every later one; tested against brute force."""
    from churnkit.llm.runs import periodic_runs

    found = periodic_runs(with_periods(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.col3")).alias("period"), F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
                    F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvectors aren't SQL; tested against numpy on the whole small table."""
    from churnkit.llm.whitening import whiten_vectors

    found = whiten_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n", "deviation", F.inline("whitened")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens aren't SQL; tested against the tokenizer's library: every id once, sequences without gaps."""
    import public_tokenizers

    from churnkit.llm.packing import pack_documents

    found = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
