"""Corpus preparation in five stages, each an operator of ``tally.llm``.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents. ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import bpe, decontaminate, langid, linededup, neardup
from tally.llm.common import remainder, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5  # posterior probability below which a language counts as unknown


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; ``und`` and undecided ones go.

    The model learns from the text and language of those not held out, as op2 does.
    """
    model = langid.fit(docs.filter(remainder(docs.doc_id, 4) != 2))
    whole = F.struct(*[docs[c] for c in COLUMNS]).alias("whole")
    found = langid.predict(docs, model, "doc_id", "text", whole)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove runs of two or more lines that occur before in the corpus from the texts."""
    out = linededup.dedup_runs(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 80 %): that with the least id.

    Rows of one id stay or go together, since groups are named by id.
    """
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("keep")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("keep")), "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    leaks = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    bad = leaks.select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("own_hash"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("text_hash")), "left_anti").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it again."""
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
ORACLE_SQL = None  # hashing, minhash and tokenizers are beyond SQL: see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
