"""Reading a corpus and ingesting raw files."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import decoded
from lexloom.operators.store import of_language
from lexloom.schema import MAX_FILE_BYTES
from lexloom.session import file_system, stored_bytes

# Bytes of files read by a task; splits of the file source, of a few files each, at most.
TASK_BYTES = 32 * 1024 * 1024
TASK_SPLITS = 256


def corpus_frame(source: DataFrame, language: str | None = None) -> DataFrame:
    """(language, code) from either layout of a corpus table.

    The current layout keeps the text in `content`, the older one in `snippet`.
    """
    text = "content" if "content" in source.columns else "snippet"
    return of_language(source, language).select("language", F.col(text).alias("code"))


def spread(scan: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash the files of a plain scan over all cores if it has too few splits.

    A small input may be one split, which would tokenise on one core. Large
    inputs have many splits and pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(3 * cores, key)


def read_corpus(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    return corpus_frame(spark.read.parquet(path), language)


def read_database(
    spark: SparkSession, language: str | None = None, database: str | None = None
) -> DataFrame:
    """Corpus of a catalog database: `code` beside `progress`, else `snippets`."""
    qualifier = f"{database}." if database else ""
    current = spark.catalog.tableExists(f"{qualifier}progress")
    table = spark.table(f"{qualifier}code" if current else f"{qualifier}snippets")
    return corpus_frame(table, language)


def read_jdbc(
    spark: SparkSession, url: str, language: str | None = None, **options: str
) -> DataFrame:
    """Corpus in a relational file or server, where its driver jar is present."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return corpus_frame(reader.option("dbtable", "code").load(), language)


def _written(folder: str, prefix: str):
    """Write the lines of each key, which come together, into a file; counts the files."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column("key").to_pylist(), batch.column("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        task = TaskContext.get()
        path, many = f"{path}/part-{task.partitionId():05d}", 0
        for key, rows in groupby(lines(batches), lambda row: row[0]):
            if not many:
                system.create_dir(path, recursive=True)
            # Written under a name of this attempt, so that the file of another attempt is never cut.
            name, own = f"{path}/{prefix}{key}.txt", f"{path}/_{task.taskAttemptId()}"
            with system.open_output_stream(own) as out:
                for _, text in rows:
                    if text.is_valid:
                        out.write(text.as_buffer())
                    out.write(b"\n")
            try:
                system.move(own, name)
            except OSError:
                # Some stores don't replace files: another attempt has written the same one.
                if not system.get_file_info(name).is_file:
                    raise
                system.delete_file(own)
            many += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([many], pa.int64())})

    return run


def write_files(rows: DataFrame, path: str, key: str, text: str, tasks: int) -> int:
    """Each key as a raw file `part-*/{key}=*.txt` that holds its texts as lines; returns how many files.

    A folder for each task and files written as they are: Spark's writer needs a folder for each key and, on
    local disks, a process for the mode of each folder and file.
    """
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    dealt = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition(tasks, "key")
    written = dealt.sortWithinPartitions("key", "text").mapInArrow(_written(folder.toString(), f"{key}="), "files long")
    return sum(row["files"] for row in written.collect())


def _few_tasks(files: DataFrame) -> DataFrame:
    """A scan of files in tasks of some size: to the file source a file counts as 4 MB at least, so that short ones make many splits."""
    splits = files.rdd.getNumPartitions()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(3 * cores, stored_bytes(files) // TASK_BYTES, splits // TASK_SPLITS)
    return files.coalesce(tasks) if tasks < splits else files


def ingest_files(
    spark: SparkSession,
    path: str,
    charset: str = "UTF-8",
    pattern: str = "*",
    cap: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Raw files as (url, content, size, reject), at most `cap` bytes of UTF-8 text each.

    `size` counts the decoded text. A file that cannot be decoded has no content
    and a reason in `reject`. The test pushed into the file source only drops
    files that are too large in every charset: text shrinks at most to a
    quarter, and a byte order mark may go.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    if cap:
        files = files.where(F.col("length") <= 4 * cap + 4)
    text = _few_tasks(files).select(
        F.col("path").alias("url"), decoded(F.col("content"), F.lit(charset)).alias("content")
    ).withColumn("size", F.octet_length("content").cast("long"))
    if cap:
        text = text.where(F.col("content").isNull() | (F.col("size") <= cap))
    return text.withColumn("reject", F.when(F.col("content").isNull(), f"not {charset}"))
