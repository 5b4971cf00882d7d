"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, hard_negatives, knn, license_scan, line_dedup, ngram_lm, pii, simhash, toxicity, url_filter, whitening
from .common import table

# The rules of op5, as (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = ngram_lm.train(docs.where(~held_out))
    scored = ngram_lm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no block list, so this stands in for one: the keys whose MD5 begins with 0 or 1."""
    pages = table(spark, sf_dir, "pages")
    keys = pages.select(F.concat(url_filter.host("url"), url_filter.path("url")).alias("key"))
    listed = keys.where(F.substring(F.md5("key"), 1, 1).isin("0", "1"))
    return url_filter.judge(pages, URL_RULES, listed)


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
found AS (
  SELECT p.*, (SELECT max_by({'rule': rhost || rpath, 'verdict': verdict}, length(rhost || rpath)) FROM rules
               WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS r
  FROM parts p)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN substr(md5(host || path), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END) AS verdict
FROM found
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 5
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = rows.unionByName(own).select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    return chat.read_back(chat.format_turns(turns))


#: Formatted length: each turn's marks are 16 code points beside its role and content, and escaping
#: adds one for each backslash and ``<`` (in a role also ``>`` and newline).
OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(role) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + length(regexp_replace(role, '[^\\<>\n]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def _template_pattern(markup: str) -> str:
    """A template as a pattern over words that each follow a space."""
    out = ""
    for item in re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", markup):
        out += {"[[": "(", "]]": ")?"}.get(item) or (f"( [^ ]+){{{item[2:-2]}}}" if item.startswith("{{") else f" {item}")
    return f"{out} "


def op8_sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    starts = " || ".join(
        "list_filter(range(1, n + 1), lambda i: " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split())) + ")" for phrase, _ in license_scan.PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(spaced, ' {phrase} ') THEN '{label}' END" for phrase, label in license_scan.PHRASES)
    found = ", ".join(f"CASE WHEN regexp_matches(spaced, '{_template_pattern(markup)}') THEN '{label}' END" for label, markup in license_scan.TEMPLATES)
    return f"""
WITH w AS (SELECT doc_id, {words} AS ws FROM documents),
s AS (SELECT *, len(ws) AS n, ' ' || array_to_string(ws, ' ') || ' ' AS spaced FROM w),
r AS (SELECT doc_id, n, {starts} AS spots, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_filter([{found}], lambda x: x IS NOT NULL) AS found FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || found)), ',') AS labels,
       CASE WHEN len(found) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM r
"""


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, label)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(range(1, least(len(a.e), len(c.e)) + 1), lambda i: a.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.r <> a.r),
p AS (
  SELECT r, vec_id AS positive_id, score AS positive_score, row_number() OVER w AS slot FROM s WHERE same
  WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (r) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY r, slot ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 10
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_lines": op2_lines, "op3_lm": op3_lm, "op4_simhash": op4_simhash, "op5_urls": op5_urls, "op6_topk": op6_topk, "op7_chat": op7_chat, "op8_licenses": op8_licenses, "op9_leaks": op9_leaks, "op10_bpe": op10_bpe, "op11_pii": op11_pii, "op12_negatives": op12_negatives, "op13_whitening": op13_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": OP5_SQL, "op6_topk": OP6_SQL, "op7_chat": OP7_SQL, "op8_licenses": op8_sql(), "op12_negatives": OP12_SQL}
