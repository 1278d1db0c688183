"""Catalogue of this subpackage: one query per operator, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import ann, bpe, chat, ctw, decontaminate, hard_negatives, langid, licenses, linededup, neardup, periods, token_counts, toxicity
from tally.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text they decode to, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by a model that learns from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = remainder(docs.doc_id, 4) == 2
    model = langid.fit(docs.filter(~held))
    return langid.predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts and whether they exceed the context length."""
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


@register
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole documents on 2-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


@register
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting scores and unigram base of whole documents."""
    docs = table(spark, sf_dir, "documents")
    out = ctw.lm_scores(docs, remainder(docs.doc_id, 5) == 1)
    return out.withColumn("bits_per_byte", -F.col("score") * F.lit(3.321928094887362) / (F.col("n_bytes") + 1))


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a classifier that learns from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.classify(docs, labels.filter(remainder(labels.doc_id, 5) != 0))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@register
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every row whose id is divisible by 20."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of documents with benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the runs of two or more lines that occur before in the table."""
    return linededup.dedup_runs(table(spark, sf_dir, "documents"))


@register
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@register
def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of whole documents, of which a tenth are first made periodic from some word on."""
    docs = table(spark, sf_dir, "documents")
    h = F.crc32(F.coalesce(docs.doc_id.cast("string"), F.lit("")).cast("binary"))
    w = F.filter(F.split(docs.text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, w).alias("w"))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    chosen = chosen.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    period = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    periodic = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(period), F.lit(1), rest))
    out = periods.periodic_runs(chosen.select("doc_id", F.coalesce(F.array_join(periodic, " "), "text").alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    out = out.withColumn("r", longest).withColumn("length", -F.col("r.less"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"), "length", F.col("r.period").alias("period"),
                      F.expr("(1000 * length) div r.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, and one whose texts hold the template's own control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


ORACLE["op10_minhash_dedup"] = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, w, UNNEST(range(1, greatest(len(w), 2))) AS i FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM p),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 80 * (nx.n + ny.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, MIN(other) AS component_id FROM r GROUP BY doc_id) k ON k.doc_id = d.doc_id"""


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, with the labels of every seventh id moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


ORACLE["op13_chat"] = """
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, ROW_NUMBER() OVER w AS i, LAG(role) OVER w AS prev,
         length(text) + length(regexp_replace(text, '[^\\x5C]', '', 'g')) + len(regexp_extract_all(text, '</s>|\\[(OUT|/?INST|/?SYS|/?ROLE|TEXT)\\]'))
           + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 END AS formatted
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (
  SELECT *, NOT ((prev IS NULL AND role IN ('system', 'user')) OR (prev IS NOT NULL AND (prev, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))) AS bad
  FROM t)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(formatted) AS BIGINT) AS formatted_chars, COUNT(*) FILTER (WHERE bad) AS n_errors,
       MIN(i) FILTER (WHERE bad) AS first_error, arg_max(role, i) = 'assistant' AS complete
FROM b GROUP BY conv_id"""
