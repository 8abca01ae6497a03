"""Session set-up and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of a row group in tables that tasks read themselves.
GROUP_BYTES = 16 * 1024 * 1024
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would lose data with the executor that wrote it.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="lexloom-")
    spark.conf.set(CHECKPOINT_CONF, own)
    return own


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate results."""
    return f"{shared_dir(spark)}/lexloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the run folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_run_folder(spark: SparkSession) -> None:
    """Delete this application's intermediate results when they are used up."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage so that lost executors cost nothing, lets several
    consumers share one computation, and gives the planner a true size: it
    then broadcasts the result only below `spark.sql.autoBroadcastJoinThreshold`
    and falls back to a shuffled join above it. Shuffle files of the computation go
    with it. With `by`, each value of this column has files of its own (see `files_by`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error")
    if by:
        writer = writer.partitionBy(by).options(**{"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)})
    kept = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        if kept is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, kept)
    return spark.read.schema(df.schema).parquet(path)


def files_by(stored: DataFrame, by: str) -> dict[int, list[str]]:
    """Files of each number in the column that a table was stored by; none of other tables."""
    found: dict[int, list[str]] = {}
    for file in sorted(stored.inputFiles(), key=lambda file: file.rsplit("/", 1)[1]):
        number = re.search(rf"/{by}=(\d+)/[^/]+$", file)
        if number:
            found.setdefault(int(number[1]), []).append(file)
    return found


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a full URI, for tasks that read and write files themselves."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def drop(stored: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    spark = stored.sparkSession
    for folder in {re.sub(r"(/lexloom-[^/]+/\w+-[0-9a-f]{32})/.*", r"\1", file) for file in stored.inputFiles()}:
        if re.search(r"/lexloom-[^/]+/\w+-[0-9a-f]{32}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(stored: DataFrame) -> int:
    """Size of a stored table on disk, as the planner sees it."""
    stats = stored._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_if_small(stored: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored side table for broadcast if its files are within `limit`.

    For lookups by token the other side is every token of the corpus, so a
    larger table than Spark's default may be sent around before shuffling that
    is cheaper. Above the limit the planner is left to join by shuffle.
    """
    return F.broadcast(stored) if stored_bytes(stored) <= limit else stored
