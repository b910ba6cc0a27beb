"""The pipeline against a plain re-computation of its stages, and the registration of its queries."""

import importlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from churnkit.llm.byte_bpe import read_ranks
from churnkit.llm.labelled import fold
from churnkit.llm.quality import fit_quality, score_quality
from tests.llm.helpers import components
from tests.llm.test_decontamination import plain
from tests.llm.test_pii import plain_base

SF = "/root/testdata/sf0.001"


def test_run_like_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) != 0)
    good = score_quality(docs, model).filter("score >= 0.3").orderBy("doc_id").select("doc_id", "text").collect()
    ids, texts = [r.doc_id for r in good], [r.text for r in good]
    roots, _ = components(texts)
    first = [i for i, r in enumerate(roots) if i == r]
    clean = [i for i in first if not plain(texts[i], items)[3]]

    tokens = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in enumerate(tokens)}, special_tokens={})
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == {ids[i] for i in clean} and 0 < len(clean) < len(first) < len(ids)
    for i in clean:
        row = out[ids[i]]
        decoded = b"".join(tokens[int.from_bytes(row.token_ids[k:k + 4], "little")] for k in range(0, len(row.token_ids), 4)).decode()
        assert library.encode_ordinary(decoded) and row.n_tokens == len(library.encode_ordinary(decoded)) or not decoded
        base = plain_base(texts[i])
        for a, _, b in base:
            assert texts[i][a:b] not in decoded or texts[i][a:b].isdigit()
        if not base and decoded != texts[i]:
            assert "[" in decoded
        assert all(kind in decoded for kind, k in (("[EMAIL]", 0), ("[IP]", 1), ("[PHONE]", 3)) if any(s[1] == k for s in base))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("extra", F.lit(1)), SF)
        assert out.columns == docs.columns + ["extra"]


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
