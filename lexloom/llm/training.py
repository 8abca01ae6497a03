"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import durable

FOLDS = 3
HELD_OUT = 1
TEXT_BYTES = 4 << 20
SAMPLE_BYTES = 256 << 20
_HASH_RANGE = 1 << 30


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept for measuring: crc32 of its id, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """About `rows` labelled training documents at most: `order`, `text` and `y` (0 or 1).

    Held-out documents and rows without id, label or text are left out. The
    sample is chosen by a hash of the id, so reruns agree; its size is a stated
    bound of the model, and the chosen ids are few enough to be broadcast. A
    document with contrary labels keeps the larger one. Of several rows with one
    id one is taken, that with the least hash of its text, before anything is
    shuffled. Texts of more than TEXT_BYTES are not learnt from, and in the order
    of the sample none beyond SAMPLE_BYTES in all, so that one task can hold it.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max(label) >= 1).cast("int").alias("y"))
    )
    total = usable.count()
    share = min(1.0, rows / total) if total else 1.0
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE))
    of_id = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    size = F.octet_length("text").cast("long")
    once = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (size <= TEXT_BYTES))
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("_nth", F.row_number().over(of_id))
        .where(F.col("_nth") == 1)
    )
    sample = durable(once.select(F.xxhash64(F.lit(7), "doc_id").alias("order"), size.alias("size"), "text", "y"), "sample")
    # One narrow row for each chosen id.
    so_far = sample.select("order", F.sum("size").over(Window.orderBy("order")).alias("so_far"))
    beyond = so_far.where(F.col("so_far") > SAMPLE_BYTES).agg(F.min("order")).first()[0]
    kept = sample if beyond is None else sample.where(F.col("order") < beyond)
    return kept.select("order", "text", "y")
