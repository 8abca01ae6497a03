"""Queries over the deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import jaccard_join, substring_dedup, suffix_dedup
from lexloom.llm.registry import query, table

SQL_SUBSTRING = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
g AS (SELECT doc_id, p, array_agg(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win FROM t),
f AS (SELECT win, min(doc_id) AS first_doc FROM g WHERE len(win) = 13 GROUP BY win),
hits AS (SELECT g.doc_id, g.p FROM g JOIN f USING (win) WHERE f.first_doc < g.doc_id),
marked AS (SELECT t.doc_id, t.p, t.word, coalesce(max(h.p) OVER (PARTITION BY t.doc_id ORDER BY t.p) > t.p - 13, false) AS gone
  FROM t LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.p = t.p)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(m.n_removed, 0) AS n_removed,
  sha256(coalesce(m.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
  string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id) m USING (doc_id)
"""


@query("op5_substring_dedup", SQL_SUBSTRING)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
