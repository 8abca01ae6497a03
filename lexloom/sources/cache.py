"""Tokenised corpus kept on disk and reused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def stored_or_built(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = True
) -> DataFrame:
    """Read the table at `path` if there is one, else build and write it.

    Files are laid out by language, so that a filter on it skips the others.
    """
    if use_cache:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").partitionBy("language").parquet(path)
    return spark.read.parquet(path)
