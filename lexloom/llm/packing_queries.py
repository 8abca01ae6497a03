"""Query over packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import packing
from lexloom.llm.registry import query, table


@query("op11_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf, "documents")))
