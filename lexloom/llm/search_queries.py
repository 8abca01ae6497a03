"""Queries over searches: test items in documents, neighbours of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, neighbours
from lexloom.llm.registry import query, table


@query("op1_decontamination")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_neighbours")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))
