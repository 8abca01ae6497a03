"""Catalog tables of a corpus database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.store import insert_or_ignore
from lexloom.schema import CODE, PROGRESS

TABLES = {"code": CODE, "progress": PROGRESS}


def create_tables(spark: SparkSession, location: str, prefix: str = "") -> None:
    """Create both tables where they are absent."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) "
            f"USING parquet LOCATION '{location}/{name}'"
        )


def drop_tables(spark: SparkSession, prefix: str = "") -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def append_rows(rows: DataFrame, table: str) -> None:
    """Append in the table's own column order."""
    spark = rows.sparkSession
    rows.select(spark.table(table).columns).write.insertInto(table)


def insert_new_files(batch: DataFrame, table: str) -> None:
    """Append the files of a batch whose hash the table lacks, one per hash."""
    stored = batch.sparkSession.table(table)
    append_rows(insert_or_ignore(batch, stored), table)
