"""Queries over archives and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import mixing, warc
from lexloom.llm.registry import query, table

SQL_WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

SQL_MIX = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, sum(2 * source_size) OVER w AS capped, sum(weight) OVER w AS used,
    sum(weight) OVER () AS weights, sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT greatest(max(CAST(total * 150 AS DOUBLE) / 100 / weights),
    max((CAST(total * 150 AS DOUBLE) / 100 - capped) / (weights - used)) FILTER (WHERE weights > used)) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN weight * level >= 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE weight * level END AS target FROM s, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS rounds FROM t),
e AS (SELECT d.*, b.source_size, b.target, b.rounds, CAST(floor(b.target) AS BIGINT) - b.rounds * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.hash) AS tied
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * rounds + CASE WHEN upto <= budget THEN size WHEN upto - tied < budget THEN size * (budget - (upto - tied)) // tied ELSE 0 END AS BIGINT) AS taken
FROM e
"""


@query("op2_warc", SQL_WARC)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    captures = warc.write_archives(table(spark, sf, "pages"), folder)
    parts = warc.build_index(captures, folder)
    return warc.lookup(parts, table(spark, sf, "pages").select("url"), folder)


@query("op3_mixing", SQL_MIX)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))
