"""The operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cyclecast.llm import bpe, fim, langid, linededup, mtree, packing, pii, ranked, sharding, simhash, substrings, urlrules, vptree
from cyclecast.llm.common import prepare
from cyclecast.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP4_SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE place = 1
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, window=1024)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.report(table(spark, sf_dir, "documents"))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mtree.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP7_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT q.id AS query_id, d.id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.id % 50 = 0 AND d.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vptree.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return linededup.report(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM rows),
counted AS (SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM totals) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counted GROUP BY t),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE item_id IS NOT NULL),
scored AS (
  SELECT i.item_id, c.r, c.doc_id, CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * l.n * x.docs) // x.all_terms)))) AS BIGINT) AS score
  FROM items i JOIN counted c USING (t) JOIN weights w USING (t) JOIN lengths l USING (r) CROSS JOIN totals x GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substrings.report(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (
  SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS h
  FROM texts, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
firsts AS (SELECT h, min(doc_id) AS d FROM words WHERE h IS NOT NULL GROUP BY h),
marked AS (SELECT r, i, word, coalesce(words.doc_id > d, false) AS late FROM words LEFT JOIN firsts USING (h)),
covered AS (SELECT r, i, word, bool_or(late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM marked),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM covered),
kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_repeats, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM runs GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_repeats, 0) AS n_repeats, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fim.report(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * i + 1, 8) AS BIGINT)) AS h
  FROM documents),
spans AS (
  SELECT doc_id, text, t, len(t) AS n, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS a, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, coalesce(list_aggregate(t[1:a], 'string_agg', ''), '') AS p, coalesce(list_aggregate(t[a + 1:b], 'string_agg', ''), '') AS m, coalesce(list_aggregate(t[b + 1:n], 'string_agg', ''), '') AS s
  FROM spans)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


QUERIES = {"op1_simhash": op1_simhash, "op2_bpe": op2_bpe, "op3_language_id": op3_language_id, "op4_url_rules": op4_url_rules, "op5_packing": op5_packing, "op6_pii": op6_pii, "op7_mtree": op7_mtree, "op8_vptree": op8_vptree, "op9_line_dedup": op9_line_dedup, "op10_sharding": op10_sharding, "op11_ranked": op11_ranked, "op12_substrings": op12_substrings, "op13_fim": op13_fim}

ORACLE_SQL: dict[str, str] = {"op4_url_rules": OP4_SQL, "op7_mtree": OP7_SQL, "op11_ranked": OP11_SQL, "op12_substrings": OP12_SQL, "op13_fim": OP13_SQL}
