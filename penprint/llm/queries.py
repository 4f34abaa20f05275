"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embed_dedup, license_scan, minhash, mixing, quality, suffix_dedup, topk, url_filter
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the strings of 400 bytes, passages of 50 words or more: most hold no such string. They are told as in the pipeline."""
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=200, words=50)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at ``source/lang/doc_id.txt``, so a document that is mostly licence speaks for its source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "evidence", "site", "quality", "accepted")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_mix_sources, op3_embed_dedup, op4_byte_bpe, op5_suffix_dedup, op6_license_scan, op7_quality_classifier, op8_order_minhash, op9_exact_topk, op10_chat_format)}

ORACLE_SQL: dict[str, str] = {
    "op3_embed_dedup": r"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS t FROM e a JOIN e b ON a.label = b.label AND len(a.f) = len(b.f) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.f, b.f) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS u FROM embeddings UNION SELECT r.v, l.t FROM r JOIN l ON r.u = l.s),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY 1), n AS (SELECT s, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON v = vec_id LEFT JOIN n ON s = vec_id""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, role || chr(0) || text AS rt, contains(role, '[INST]') OR contains(text, '[/INST]</s>') AS escaped FROM c),
e AS (SELECT *, 27 + length(role) + length(text) + CASE WHEN escaped THEN length(rt) - length(replace(rt, '\', '')) + len(regexp_extract_all(rt, '<s>|\[ROLE|\[INST\]|\[/INST\]|</s>')) ELSE 0 END AS n FROM k)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op9_exact_topk": r"""
WITH v AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT id, len(q) AS n, unnest(range(1, len(q) + 1)) AS d, unnest(q) AS x FROM v),
s AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.d = b.d AND a.n = b.n AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op1_url_filters": r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT row_number() OVER () AS n, page_id,
  translate(coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') END, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path FROM pages),
m AS (SELECT p.*, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict = 'block' DESC) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}
