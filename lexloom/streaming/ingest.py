"""Resumable ingest of fetched files with Structured Streaming.

The file source and its checkpoint remember what has been read, so a run picks
up where the last one stopped. Dedup state is the corpus table itself, not the
state store; its hashes are looked up through filters. A row of page FINISHED_PAGE,
without a file, says that its query has no more pages; the query is marked as
finished once all of them are stored. Every step may be replayed after a lost
executor or driver: batch tables are overwritten by batch number and inserts skip
stored hashes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.store import (
    allowed_extensions,
    first_arrivals,
    latest_progress,
    not_stored,
    pages_within_budget,
    within_size,
)
from lexloom.schema import CODE, FINISHED_PAGE, MAX_FILE_BYTES
from lexloom.session import durable
from lexloom.streaming.history import History

FETCHED = T.StructType(CODE.fields + [T.StructField("query", T.StringType()), T.StructField("page", T.LongType())])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Ingest:
    """Tables of one ingest under `root`: code, bytes and progress, each laid
    out by batch number."""

    def __init__(
        self, spark: SparkSession, root: str, budget: int = 0, cap: int = MAX_FILE_BYTES
    ) -> None:
        """`budget` bytes per language and `cap` bytes per file; 0 is no limit."""
        self.spark = spark
        self.cap = cap
        self.root = root.rstrip("/")
        self.budget = budget
        self.history = History(spark, self.root)

    # Each batch rewrites only its own folder, hence replays are harmless.
    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def _before(self, table: str, schema: T.StructType, batch: int) -> DataFrame:
        with_batch = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
        rows = _read_or_empty(self.spark, f"{self.root}/{table}", with_batch)
        return rows.where(F.col("batch") < batch)

    def code(self) -> DataFrame:
        return _read_or_empty(self.spark, f"{self.root}/code", CODE)

    def bytes_stored(self) -> DataFrame:
        """Running bytes per language."""
        schema = T.StructType.fromDDL("language string, bytes bigint")
        rows = _read_or_empty(self.spark, f"{self.root}/bytes", schema)
        return rows.groupBy("language").agg(F.sum("bytes").alias("total_size"))

    def progress(self) -> DataFrame:
        schema = T.StructType.fromDDL("language string, query string, last_page bigint, batch bigint")
        history = _read_or_empty(self.spark, f"{self.root}/progress", schema)
        return latest_progress(history, "batch")

    def _numbers(self, table: str) -> list[int]:
        """Numbers of the batches written to a table, empty ones included."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [entry.getPath().getName() for entry in files.listStatus(path)]
        return sorted(int(name[6:]) for name in names if name.startswith("batch="))

    def _deferred(self, batch: int) -> DataFrame:
        """Files that the batch before had to leave for want of budget."""
        earlier = [n for n in self._numbers("deferred") if n < batch]
        if not earlier:
            return self.spark.createDataFrame([], FETCHED)
        return self.spark.read.schema(FETCHED).parquet(f"{self.root}/deferred/batch={earlier[-1]}")

    def _cuts(self, files: DataFrame, batch: int) -> DataFrame:
        """Per language the last page that starts below what earlier batches left of the budget."""
        schema = T.StructType.fromDDL("language string, bytes bigint")
        spent = (
            self._before("bytes", schema, batch)
            .groupBy("language")
            .agg(F.sum("bytes").alias("size"))
            .select("language", F.lit(-1).cast("long").alias("page"), "size")
        )
        # What is stored already counts as a page before the first one.
        pages = files.groupBy("language", "page").agg(F.sum("size").alias("size"))
        return durable(pages_within_budget(pages.unionByName(spent), self.budget), "cuts")

    def store(self, fetched: DataFrame, batch: int) -> None:
        """One micro-batch. Numbers are odd; a `resume` after it takes the even one."""
        self._store(fetched, 2 * batch + 1)

    def resume(self) -> None:
        """Go on with the pages left for want of budget, for instance under a larger one."""
        last = max(self._numbers("progress"), default=0)
        self._store(self.spark.createDataFrame([], FETCHED), last + last % 2)

    def _store(self, fetched: DataFrame, batch: int) -> None:
        """Filter, dedup against history, budget, append; what the budget cuts off is kept for later."""
        arrived = fetched.select(FETCHED.names).unionByName(self._deferred(batch))
        is_end = F.coalesce(F.col("page") == FINISHED_PAGE, F.lit(False))
        ends, waiting = arrived.where(is_end), arrived.where(~is_end)
        allowed = within_size(allowed_extensions(waiting), self.cap)
        # Read twice: to ask the history and to be stored.
        fresh = durable(first_arrivals(allowed), "arrived")
        earlier = [n for n in self._numbers("hashes") if n < batch]
        kept = not_stored(fresh, self.history.stored_among(fresh, earlier))
        late = None
        if self.budget > 0:
            # Read twice: for the page totals and for the files themselves.
            kept = durable(kept, "fresh")
            placed = kept.join(self._cuts(kept, batch), "language", "left")
            in_time = F.coalesce(F.col("page") <= F.col("cut_page"), F.lit(False))
            late = placed.where(~in_time).select(FETCHED.names)
            kept = placed.where(in_time).drop("cut_page")
        self._write(kept.select(CODE.names), "code", batch)
        if late is not None:
            late = durable(late, "late")
            # The end of a query waits for its pages.
            held = ends.join(late.select("language", "query").distinct(), ["language", "query"], "left_semi")
            late = late.unionByName(held.select(FETCHED.names))
        self._write(self.spark.createDataFrame([], FETCHED) if late is None else late, "deferred", batch)
        # Sums come from the written files, of which they read two columns.
        written = self.spark.read.schema(CODE).parquet(f"{self.root}/code/batch={batch}")
        self.history.add(written, batch)
        self._write(written.groupBy("language").agg(F.sum("size").alias("bytes")), "bytes", batch)
        # A query goes on with its first page that was cut off, else is finished or goes on behind its last page.
        left = self.spark.read.schema(FETCHED).parquet(f"{self.root}/deferred/batch={batch}")
        cut = left.where(~is_end).groupBy("language", "query").agg(F.min("page").alias("cut"))
        pages = arrived.groupBy("language", "query").agg(
            F.max("page").alias("page"), F.max(is_end).alias("ended")
        )
        behind = F.when(F.col("ended"), FINISHED_PAGE).otherwise(F.col("page") + 1)
        following = pages.join(cut, ["language", "query"], "left").select(
            "language", "query", F.coalesce("cut", behind).cast("long").alias("last_page")
        )
        self._write(following, "progress", batch)

    def start(self, path: str, files_per_trigger: int | None = None) -> StreamingQuery:
        """Ingest every file under `path` not yet read, then stop."""
        reader = self.spark.readStream.schema(FETCHED)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return (
            reader.parquet(path)
            .writeStream.foreachBatch(self.store)
            .option("checkpointLocation", f"{self.root}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
