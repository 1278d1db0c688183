"""The pipeline's stages against their operators' definitions, and the queries' registration."""

import hashlib

import public_tokenizers
import pytest
from helpers import SF, docs, fixture
from test_line_runs import brute_runs
from test_overlap import brute_components, brute_overlaps
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_stages_against_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    df = stages["language_id"](spark, df, SF)
    assert df.columns == COLUMNS and df.count() == 200  # every document has a language
    from pyspark.sql import functions as F
    keys = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    rows = [(r.doc_id, keys[r.doc_id], r.text) for r in df.collect()]
    df = stages["line_dedup"](spark, df, SF)
    want = {i: t for (i, _), (t, _) in brute_runs(rows).items()}
    assert df.columns == COLUMNS and {r.doc_id: r.text for r in df.collect()} == want
    assert all(r.n_chars == len(r.text) for r in df.collect())
    df = stages["minhash_dedup"](spark, df, SF)
    want = {i: want[i] for i, _, c in brute_components(list(want.items()), 5) if i == c}
    assert df.columns == COLUMNS and {r.doc_id: r.text for r in df.collect()} == want
    df = stages["benchmark_decontamination"](spark, df, SF)
    bad = {i for i, _ in brute_overlaps([(i, t) for i, t in want.items() if any(u[:20] in t or u[-20:] in t for _, u in fixture("benchmark"))], fixture("benchmark"))}
    assert bad and df.columns == COLUMNS and {r.doc_id for r in df.collect()} == set(want) - bad
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == set(want) - bad
    for i, r in final.items():
        assert r.ids == lib.encode(want[i], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(want[i].encode()).hexdigest()


def test_stages_on_odd_documents(spark):
    df = docs(spark).select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.count() <= df.count()
        if name == "language_id":
            assert {r.doc_id for r in out.collect()} == {None, 1, 5, 6, 7, 9}
        assert stage(spark, df.limit(0), SF).count() == 0


@pytest.mark.parametrize("n", range(1, 14))
def test_a_query_for_each_operator(n):
    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1


def test_pipeline_is_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
