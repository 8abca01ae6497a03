"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. Within a source, taking all
documents whose hash is below a threshold takes a share of its words, and a
smaller budget takes a subset of what a larger one takes. The bucket in which a
budget ends is found from the running sums of the histogram; only this bucket is
counted again by the next bits of the hash, until it holds one hash value. The
mix is then a filter on each document's own hash: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.store import dense_index
from lexloom.session import broadcast_if_small, durable

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
CAP = 2
# Bits of the hash and of one histogram level.
HASH_BITS = 60
LEVEL_BITS = 12
# A table with a row per source is broadcast below this size on disk, else joined by shuffle.
BROADCAST_BYTES = 16 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text; a null id hashes like the empty text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """`source`, `source_size` and `target` of each source.

    Sources in code-point order, null last, weigh 5, 2, 1, repeating. They share
    `share_percent` of all words by weight. Targets stop at `cap` times the
    source's size and the excess is shared by weight among the others, until
    none is above. Each round is two sums over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("_key", F.concat(F.when(F.col("source").isNull(), "b").otherwise("a"), F.coalesce("source", F.lit(""))))
    ranked = dense_index(durable(totals, "sources"), ["_key"], "_rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = durable(
        ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * cap).alias("most")),
        "sources",
    )
    level = 0.0
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        # A source is full once its share at the present level reaches its cap.
        full = F.col("weight") * F.lit(level) >= F.col("most")
        row = sources.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not row.free:
            break
        raised = (budget * share_percent / 100 - row.capped) / row.free
        if raised <= level:
            break
        level = raised
    full = F.col("weight") * F.lit(level) >= F.col("most")
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"))


def _boundaries(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """`source`, `bound` (the hash in which the budget ends), `rest` (words left for
    it) and `tied` (words that have this hash); sources without rest are left out."""
    open_ends = budgets.where("budget > 0").select(
        "source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest")
    )
    open_ends = broadcast_if_small(durable(open_ends, "budgets"), BROADCAST_BYTES)
    done = None
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        prefix = F.shiftright("hash", HASH_BITS - used)
        # Only documents in the bucket where their source's budget ends are counted again.
        inside = sized.join(open_ends, sized["source"].eqNullSafe(open_ends["source"])).where(
            F.shiftright("hash", HASH_BITS - used + LEVEL_BITS) == F.col("prefix")
        )
        histogram = inside.groupBy(sized["source"], prefix.alias("bucket"), "rest").agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        before = F.coalesce(
            F.sum("words").over(
                Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        )
        ends = (
            histogram.withColumn("before", before)
            .where("before < rest AND rest <= before + words")
            .select("source", "bucket", (F.col("rest") - F.col("before")).alias("rest"), "words", "low", "high")
        )
        ends = durable(ends, "ends")
        settled = ends.where("low = high").select("source", F.col("low").alias("bound"), "rest", F.col("words").alias("tied"))
        done = settled if done is None else done.unionByName(settled)
        open_ends = ends.where("low < high").select("source", F.col("bucket").alias("prefix"), "rest")
        if used == HASH_BITS or open_ends.limit(1).count() == 0:
            break
    return done


def mix(docs: DataFrame) -> DataFrame:
    """How many words of each document the mix takes.

    Takes `doc_id`, `text` and `source`; returns `doc_id`, `size`,
    `source_size`, `target` and `taken`, a row for each row of `docs`. Each
    source gives its target in whole words, rounded down: all of its documents
    as often as the target allows, then those whose hash is below the source's
    threshold once more, and the document at the threshold with the first words
    that are still wanted. Documents with one hash at a threshold (repeated
    rows) share what is left by their sizes, rounded down. A null text has size
    0. A null source is a source of its own. Hashes depend on the doc_id alone,
    so reruns agree. Other columns are not used.
    """
    sized = durable(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("hash")),
        "sizes",
    )
    targets = durable(source_targets(sized), "targets")
    shares = targets.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0))
    shares = shares.withColumn("budget", F.floor("target") - F.col("rounds") * F.col("source_size"))
    ends = _boundaries(sized, shares.select("source", "budget"))
    known = durable(
        shares.join(ends.withColumnRenamed("source", "_s"), shares["source"].eqNullSafe(F.col("_s")), "left").drop("_s"),
        "thresholds",
    ).withColumnRenamed("source", "_s")
    extra = (
        F.when(F.col("hash") < F.col("bound"), F.col("size"))
        .when(F.col("hash") == F.col("bound"), F.expr("size * rest div tied"))
        .otherwise(0)
    )
    return sized.join(known, sized["source"].eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds") + extra).cast("long").alias("taken")
    )
