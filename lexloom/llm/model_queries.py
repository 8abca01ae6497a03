"""Queries over the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import quality, toxicity
from lexloom.llm.registry import query, table


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))
