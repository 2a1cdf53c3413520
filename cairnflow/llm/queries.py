"""Registered queries of the pipeline operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import conversation_repair, decontamination, language_id, lm_scoring, mixing, near_dedup, quality_ranking, quality_rules, substring_dedup, suffix_dedup, toxicity, url_filters, whitening
from cairnflow.llm.common import table
from cairnflow.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.inspect(table(spark, sf_dir, "documents"), good)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.inspect(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.inspect(table(spark, sf_dir, "documents"))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_ranking.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.inspect(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring_dedup.inspect(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.inspect(conversations, conversation_repair.damage(conversations))


#: The rules of the filter list.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitening.inspect(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_ranking": op4_quality_ranking,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filters": op12_url_filters,
    "op13_embedding_whitening": op13_embedding_whitening,
}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MIX_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op3_suffix_dedup": """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
size AS (SELECT doc_id, h, len(h) // 2 AS n FROM doc),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS win FROM size, LATERAL (SELECT unnest(range(1, n - 198)) AS i)),
often AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
start AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM win SEMI JOIN often USING (win)),
span AS (
    SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (
        SELECT doc_id, i, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM start)
    GROUP BY doc_id, nth),
edge AS (
    SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS since FROM span),
rest AS (
    SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last, string_agg(substr(h, 2 * since - 1, 2 * (lo - since)), '' ORDER BY lo) AS kept
    FROM edge JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256
FROM size LEFT JOIN rest USING (doc_id)""",
    "op5_decontamination": rf"""
WITH item AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
    SELECT DISTINCT item_id, w[i:i + least(13, len(w)) - 1] AS win
    FROM item, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{WORDS}'), []) AS w FROM documents),
placed AS (
    SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
found AS (SELECT doc_id, n, i, item_id FROM placed JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + n)) AS word) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_substring_dedup": rf"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{MIX_WORDS}'), []) AS w FROM documents),
win AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
home AS (SELECT win, min(doc_id) AS home FROM win GROUP BY win),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN home USING (win) WHERE doc_id > home),
word AS (SELECT doc_id, w, i FROM doc, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(w[i], ' ' ORDER BY i) AS rest FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)""",
    "op10_mixing": rf"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{MIX_WORDS}')), 0) AS size,
    md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR), source)) AS turn FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(nth % 3 + 1 AS DOUBLE) AS weight
    FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM by_source)),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goals AS (
    SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM levels),
placed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, p.source AS source,
    CAST(CASE WHEN size > 0 THEN size * greatest(0, least(3, floor((target - upto) / source_size) + 1)) ELSE 0 END AS BIGINT) AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source""",
    "op12_url_filters": r"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS name FROM cut),
page AS (
    SELECT page_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path FROM named),
best AS (
    SELECT host, path, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host) + length(rule_path)) AS r
    FROM (SELECT DISTINCT host, path FROM page) JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM page LEFT JOIN best USING (host, path)""",
}
