"""The registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lines, minhash, mixing, pii, sharding, toxicity, urls, warc
from .common import table

#: The list of op3: all page URLs of hosts with one of these names (fixed values).
LISTED_HOSTS = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."


def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured_at")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.rlike(urls.host_of(F.col("url")), F.lit(LISTED_HOSTS))).select("url")
    return urls.judge_urls(pages, listed)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks_by_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id, position('://' IN url) > 0 AS has, substr(url, position('://' IN url) + 3) AS rest FROM pages
), split AS (
  SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN has THEN regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) ELSE '' END AS query, coalesce(has, false) AS has FROM parts
), canon AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE WHEN has THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') || '?' ||
           array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))), '&') END AS canon
  FROM split
), listed AS (
  SELECT DISTINCT canon FROM canon WHERE canon IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}')
), ruled AS (
  SELECT *, canon IS NOT NULL AND canon IN (SELECT canon FROM listed) AS listed,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM canon
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to,
  strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM d LEFT JOIN f USING (payload_digest)
"""

OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), shown AS (
  SELECT * FROM lines WHERE regexp_matches(line, '\S')
), firsts AS (
  SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM shown GROUP BY line
), halves AS (
  SELECT DISTINCT line, first, h FROM (
    SELECT line, first, unnest([
      'P' || left(line, n // 2), 'S' || right(line, n - n // 2),
      'P' || left(line, (n - 1) // 2), 'S' || right(line, n - 1 - (n - 1) // 2)]) AS h
    FROM firsts WHERE n >= 5)
), pairs AS (
  SELECT DISTINCT a.line AS earlier, a.first AS keeper, b.line AS later
  FROM halves a JOIN halves b ON a.h = b.h AND a.first < b.first AND abs(length(a.line) - length(b.line)) <= 1
), near AS (
  SELECT later AS line, min(keeper) AS keeper FROM pairs WHERE levenshtein(earlier, later) <= 1 GROUP BY later
), gone AS (
  SELECT s.doc_id, s.line_no, (s.doc_id, s.line_no) <> f.first AS exact,
    CASE WHEN (s.doc_id, s.line_no) <> f.first THEN f.first ELSE n.keeper END AS k
  FROM shown s JOIN firsts f USING (line) LEFT JOIN near n USING (line)
  WHERE (s.doc_id, s.line_no) <> f.first OR n.keeper IS NOT NULL
)
SELECT d.doc_id, count(*) FILTER (WHERE exact) AS lines_exact, count(*) FILTER (WHERE NOT exact) AS lines_near,
  coalesce(string_agg(line_no || '=' || k[1] || ':' || k[2], ',' ORDER BY line_no), '') AS dropped
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id
"""

QUERIES = (
    op1_balanced_shards,
    op2_warc_index,
    op3_url_filter,
    op4_nearest_neighbours,
    op5_line_dedup,
    op6_toxicity,
    op7_decontaminate,
    op8_mix_sources,
    op9_personal_data,
    op10_near_duplicates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index": OP2_SQL, "op3_url_filter": OP3_SQL, "op5_line_dedup": OP5_SQL}
