"""Hashes of an ingest's earlier batches, looked up without shuffling them.

Each batch leaves its hashes in a folder of its own, dealt into buckets, and a
Bloom filter of them. A new batch first asks the filters which folders and buckets
may hold its hashes, and reads only those. Filters are bitmaps, built by one
aggregate: a hash belongs to one bitmap of its batch and sets a few bits in it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import broadcast_if_small, durable

BUCKETS = 16
BITS = 4
BITS_PER_HASH = 16
# Bits of the bitmaps that Spark's bitmap functions build.
MAP_BITS = 32_768


def _bit(number: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), "hash"), F.lit(MAP_BITS))


def _map_of(maps: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), "hash"), maps)


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.lit(-2), "hash"), F.lit(BUCKETS)).cast("int")


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1


class History:
    """Hashes by batch under `root`: `hashes/batch=n/bucket=b` and `filters/batch=n`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.hashes = f"{root.rstrip('/')}/hashes"
        self.filters = f"{root.rstrip('/')}/filters"

    def add(self, rows: DataFrame, batch: int) -> None:
        """Keep the hashes of a batch; a replayed batch replaces what it left before."""
        narrow = rows.where(F.col("hash").isNotNull()).select("hash").distinct()
        kept = narrow.withColumn("bucket", _bucket()).repartition("bucket")
        path = f"{self.hashes}/batch={batch}"
        kept.write.mode("overwrite").partitionBy("bucket").parquet(path)
        # One row and no bucket, so that an empty batch has a folder that can be read, too.
        stored = self.spark.read.schema("hash string, bucket int").parquet(path)
        maps = 1 << max(0, math.ceil(math.log2(max(1, stored.count()) * BITS_PER_HASH / MAP_BITS)))
        bits = F.explode(F.array(*[_bit(n) for n in range(BITS)]))
        set_bits = stored.select(_map_of(F.lit(maps)).alias("map"), bits.alias("bit"))
        # Positions count from 1.
        filters = set_bits.groupBy("map").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
        filters.withColumn("maps", F.lit(maps)).write.mode("overwrite").parquet(f"{self.filters}/batch={batch}")

    def _filters(self, numbers: list[int]) -> DataFrame:
        schema = "map bigint, bits binary, maps int, batch bigint"
        paths = self.spark.read.schema(schema).option("basePath", self.filters)
        return paths.parquet(*[f"{self.filters}/batch={n}" for n in numbers])

    def possible(self, candidates: DataFrame, numbers: list[int]) -> DataFrame:
        """(hash, bucket, batch): the batches whose filter has all bits of a hash."""
        filters = self._filters(numbers)
        sizes = [row["maps"] for row in filters.select("maps").distinct().collect()]
        asked = candidates.where(F.col("hash").isNotNull()).select("hash").distinct()
        spread = asked.select("hash", F.explode(F.array(*map(F.lit, sizes))).alias("maps")) if sizes else None
        if spread is None:
            return self.spark.createDataFrame([], "hash string, bucket int, batch bigint")
        placed = spread.withColumn("map", _map_of(F.col("maps")))
        all_set = _is_set(F.col("bits"), _bit(0))
        for n in range(1, BITS):
            all_set = all_set & _is_set(F.col("bits"), _bit(n))
        met = placed.join(broadcast_if_small(filters), ["maps", "map"])
        return met.where(all_set).select("hash", _bucket().alias("bucket"), "batch")

    def stored_among(self, candidates: DataFrame, numbers: list[int]) -> DataFrame:
        """(hash) of the candidates that batches of these numbers hold.

        Candidates are few against the history: they are sent to the folders that
        may hold them, within the size of a broadcast, and joined by shuffle only
        beyond it.
        """
        if not numbers:
            return self.spark.createDataFrame([], "hash string")
        possible = durable(self.possible(candidates, numbers), "possible")
        folders: dict[int, list[int]] = {}
        for row in possible.select("batch", "bucket").distinct().collect():
            folders.setdefault(row["batch"], []).append(row["bucket"])
        if not folders:
            return possible.select("hash")
        reader = self.spark.read.schema("hash string, bucket int, batch bigint").option("basePath", self.hashes)
        history = reader.parquet(*[f"{self.hashes}/batch={batch}" for batch in sorted(folders)])
        wanted = [(F.col("batch") == n) & F.col("bucket").isin(buckets) for n, buckets in sorted(folders.items())]
        history = history.where(reduce(Column.__or__, wanted)).select("hash")
        asked = broadcast_if_small(durable(possible.select("hash").distinct(), "asked"))
        return durable(history.join(asked, "hash", "left_semi").distinct(), "stored")
