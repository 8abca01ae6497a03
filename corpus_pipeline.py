"""Pipeline over `documents`: stages written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard_join, mixing, quality, substring_dedup
from lexloom.llm.registry import table
from lexloom.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    scored = quality.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Rows that share this id stay together; documents without id belong to the
    group of the smallest id near them, and stay if there is none.
    """
    docs = docs.select(*COLUMNS)
    groups = jaccard_join.near_duplicates(docs)
    gone = groups.where("component_id < doc_id OR (doc_id IS NULL AND component_id IS NOT NULL)").select(
        F.coalesce("doc_id", F.lit(-1)).alias("_gone"), F.col("doc_id").isNull().alias("_none")
    )
    gone = durable(gone.distinct(), "gone")
    return docs.join(
        gone,
        (F.coalesce(docs["doc_id"], F.lit(-1)) == gone["_gone"]) & (docs["doc_id"].isNull() == gone["_none"]),
        "left_anti",
    )


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a smaller document holds too."""
    return substring_dedup.rewritten(docs.select(*COLUMNS)).withColumn(
        "n_chars", F.length("text").cast("long")
    ).select(*COLUMNS)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", without_test_items),
    ("mixing", mixed),
]

# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
