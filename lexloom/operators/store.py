"""Corpus store: dedup, inserts, merges, ids, budgets and crawl progress."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexloom.schema import FINISHED_PAGE, MAX_FILE_BYTES, alias_dim, extension_dim
from lexloom.functions.text import byte_length, content_hash, file_extension
from lexloom.session import durable

CODE_COLUMNS = ["language", "url", "content", "hash", "size"]


# --- filters -----------------------------------------------------------------


def of_language(df: DataFrame, language: str | None) -> DataFrame:
    """Rows of one language; None keeps every row."""
    return df if language is None else df.where(F.col("language") == F.lit(language))


def allowed_extensions(df: DataFrame, path: str = "url") -> DataFrame:
    """Files whose extension belongs to their language (case-sensitive)."""
    with_ext = df.withColumn("ext", file_extension(F.col(path)))
    return with_ext.join(extension_dim(df.sparkSession), ["language", "ext"], "left_semi").drop(
        "ext"
    )


def within_size(df: DataFrame, cap: int = MAX_FILE_BYTES) -> DataFrame:
    """Files of at most `cap` bytes; cap 0 keeps every file."""
    return df if cap == 0 else df.where(byte_length(F.col("content")) <= cap)


def canonical_language(df: DataFrame, alias: str = "alias") -> DataFrame:
    """Add `language`, NULL where the alias is unknown."""
    names = alias_dim(df.sparkSession).withColumnRenamed("alias", "_alias")
    return df.join(names, F.lower(F.col(alias)) == F.col("_alias"), "left").drop("_alias")


def with_reason(df: DataFrame, cap: int = MAX_FILE_BYTES, alias: str = "alias", path: str = "url") -> DataFrame:
    """Add `language` and the `reason` why a file is rejected, NULL for a good one.

    In this order: its language is unknown, its extension is not one of its
    language, it is larger than `cap` bytes. All three are told in one pass.
    """
    known = extension_dim(df.sparkSession).select(
        F.col("language").alias("_of"), F.col("ext").alias("_ext"), F.lit(True).alias("_allowed")
    )
    named = canonical_language(df, alias).withColumn("_found", file_extension(F.col(path)))
    joined = named.join(known, (F.col("language") == F.col("_of")) & (F.col("_found") == F.col("_ext")), "left")
    reason = (
        F.when(F.col("language").isNull(), "language")
        .when(F.col("_allowed").isNull(), "extension")
        .when((F.lit(cap) > 0) & (F.col("size") > cap), "size")
    )
    return joined.withColumn("reason", reason).drop("_found", "_of", "_ext", "_allowed")


class Sorted(NamedTuple):
    good: DataFrame
    rejects: DataFrame  # with `reason`
    counts: dict[str, int]  # files, and rejects by reason


REASONS = ["language", "extension", "size"]


def sort_out(df: DataFrame, cap: int = MAX_FILE_BYTES, alias: str = "alias", path: str = "url") -> Sorted:
    """Good files and rejects from one pass, which also counts them."""
    seen = Observation()
    marked = with_reason(df, cap, alias, path).observe(
        seen, F.count("*").alias("files"), *[F.count_if(F.col("reason") == reason).alias(reason) for reason in REASONS]
    )
    stored = durable(marked, "sorted")
    good, rejects = stored.where(F.col("reason").isNull()).drop("reason"), stored.where(F.col("reason").isNotNull())
    return Sorted(good, rejects, dict(seen.get))


def open_work(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Work items with a query that is not finished, with their resume page."""
    return last_page(items.where(F.col("query") != ""), progress).where(
        F.col("last_page") != FINISHED_PAGE
    )


def last_page(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Resume page of each (language, query), 0 where none is stored."""
    stored = progress.select("language", "query", "last_page")
    return items.join(stored, ["language", "query"], "left").withColumn(
        "last_page", F.coalesce("last_page", F.lit(0))
    )


def urls_of_content(df: DataFrame, content: Column) -> DataFrame:
    return df.where(F.col("content") == content).select("url")


# --- dedup and existence -----------------------------------------------------


def hashed(df: DataFrame) -> DataFrame:
    """Fill NULL and blank hashes from the content, where there is one."""
    if "content" not in df.columns:
        return df
    blank = F.col("hash").isNull() | (F.trim("hash") == "")
    return df.withColumn("hash", F.when(blank, content_hash(F.col("content"))).otherwise(F.col("hash")))


def first_arrivals(df: DataFrame, order: str = "id") -> DataFrame:
    """One row per hash, the one that arrived first.

    A blank hash is taken from the content first. The rank filter becomes a
    group limit on both sides of the shuffle, so each map task sends at most one
    row per hash however many copies exist.
    """
    df = hashed(df)
    arrival = Window.partitionBy("hash").orderBy(order)
    return (
        df.withColumn("_arrival", F.row_number().over(arrival))
        .where(F.col("_arrival") == 1)
        .drop("_arrival")
    )


def already_stored(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    return candidates.join(stored.select("hash"), "hash", "left_semi")


def not_stored(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    return candidates.join(stored.select("hash"), "hash", "left_anti")


def insert_or_ignore(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch to append: new hashes, first arrival of each."""
    return not_stored(first_arrivals(batch), stored)


# --- ids ---------------------------------------------------------------------


def dense_index(
    df: DataFrame, order: list[Column], name: str, first: int | Column = 0
) -> DataFrame:
    """Add consecutive numbers in global order without a one-task window.

    Rows are range-partitioned, sorted and written once. A row's number is its
    place in its file, which the file's reader knows, after the rows of all files
    before it: the files are in the order of the ranges, and their lengths (one
    row per file) are summed up. Nothing is shuffled or sorted a second time.
    """
    ranges = durable(df.repartitionByRange(*order).sortWithinPartitions(*order), "ranges")
    # The number of the range is part of the file's name.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("int")
    placed = ranges.withColumns({"_file": number, "_row": F.col("_metadata.row_index")})
    sizes = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    base = first if isinstance(first, Column) else F.lit(first)
    # One offset per range partition: at most spark.sql.shuffle.partitions rows.
    return (
        placed.join(F.broadcast(offsets), "_file")
        .withColumn(name, (F.col("_row") + F.col("_offset") + base).cast("long"))
        .drop("_file", "_row", "_offset")
    )


def rank_within(
    df: DataFrame, key: str, order: str, name: str, block: int = 10_000
) -> DataFrame:
    """Add the 1-based rank by a unique non-negative number within each key.

    Ranks are counted per block of `block` numbers and the block counts are
    summed up, so a key that holds most rows is still ranked by many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    earlier = (
        Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = (
        blocked.groupBy(key, "_block")
        .agg(F.count("*").alias("_rows"))
        .select(key, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return (
        blocked.join(bases, [key, "_block"])
        .withColumn(name, F.col("_base") + F.row_number().over(inside))
        .drop("_block", "_base")
    )


# --- merges ------------------------------------------------------------------


def merge_corpora(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target plus the source rows whose hash it lacks, under new ids.

    What is new, and its ids, is settled on ids and hashes alone; the contents of
    the source are moved once, to meet their new ids.
    """
    target, source = hashed(target), hashed(source)
    keys = durable(not_stored(first_arrivals(source.select("id", "hash")), target), "keys")
    highest = target.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    numbered = dense_index(keys, [F.col("id"), F.col("hash")], "_new", 1)
    settled = durable(
        numbered.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("_new") + highest), "settled"
    ).toDF("_id", "_hash", "_new")
    # Rows without a hash are all new; they share a key with their equals only.
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("hash").eqNullSafe(F.col("_hash"))
    appended = source.join(settled, same)
    if not source.groupBy("id", "hash").count().where("count > 1").isEmpty():
        appended = appended.dropDuplicates(["_new"])
    columns = ["id", *CODE_COLUMNS]
    return target.select(columns).unionByName(appended.withColumn("id", F.col("_new")).select(columns))


def merge_progress(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source replaces target for an equal key, even with a lower page."""
    incoming = source.select("language", "query", F.col("last_page").alias("_incoming"))
    return target.join(incoming, ["language", "query"], "full_outer").select(
        "language", "query", F.coalesce("_incoming", "last_page").alias("last_page")
    )


def latest_progress(history: DataFrame, seq: str = "seq") -> DataFrame:
    """Last write per (language, query) wins."""
    return history.groupBy("language", "query").agg(
        F.max_by("last_page", seq).alias("last_page")
    )


# --- byte budget -------------------------------------------------------------


def pages_within_budget(files: DataFrame, budget: int, block: int = 10_000) -> DataFrame:
    """Last page per language that starts below the byte budget.

    Running totals are taken over pages, in blocks of `block` pages first and
    inside each block second, so no language is summed up by a single task.
    """
    pages = files.groupBy("language", "page").agg(F.sum("size").alias("bytes"))
    pages = pages.withColumn("_block", F.floor(F.col("page") / block))
    earlier_blocks = (
        Window.partitionBy("language")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = (
        pages.groupBy("language", "_block")
        .agg(F.sum("bytes").alias("bytes"))
        .select(
            "language",
            "_block",
            F.coalesce(F.sum("bytes").over(earlier_blocks), F.lit(0)).alias("_base"),
        )
    )
    earlier_pages = (
        Window.partitionBy("language", "_block")
        .orderBy("page")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    stored_before = F.col("_base") + F.coalesce(
        F.sum("bytes").over(earlier_pages), F.lit(0)
    )
    return (
        pages.join(bases, ["language", "_block"])
        .withColumn("_before", stored_before)
        .where(F.col("_before") < budget)
        .groupBy("language")
        .agg(F.max("page").alias("cut_page"))
    )


def within_budget(files: DataFrame, budget: int) -> DataFrame:
    """Files fetched before the stored bytes of their language reach `budget`.

    The total is checked before each page, so the last page may overshoot;
    a budget of 0 or less is no budget. Sizes are never negative, hence the
    kept pages are a prefix and only one number per language joins the files.
    """
    if budget <= 0:
        return files
    cuts = durable(pages_within_budget(files, budget), "cuts")
    return (
        files.join(cuts, "language").where(F.col("page") <= F.col("cut_page")).drop("cut_page")
    )


# --- totals ------------------------------------------------------------------


def count_files(code: DataFrame) -> DataFrame:
    return code.agg(F.count("id").alias("row_count"))


def bytes_by_language(code: DataFrame, languages: DataFrame) -> DataFrame:
    """Stored bytes of every listed language, 0 where it has no file."""
    totals = code.groupBy("language").agg(F.sum("size").alias("total_size"))
    return languages.select("language").join(totals, "language", "left").select(
        "language", F.coalesce("total_size", F.lit(0)).alias("total_size")
    )
