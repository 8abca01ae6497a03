"""Hard negatives by a secondary-sort shuffle.

Anchors meet all rows in blocks, as one exact matrix product each. Of a block an
anchor keeps its best rows of the same label and, once its positives are known,
of each positive's window the best rows of other labels: no later step can ask a
block for more. What is kept is packed into keys of (anchor, descending score,
id). `repartitionAndSortWithinPartitions` brings an anchor's keys together in
this order, and an iterator reads them as a stream: a positive opens a window of
scores below its own, and the negatives that come by are given to the windows
open for them. A task holds the open windows of one anchor, never its rows.

Rows without id, label or vector, or with a null or non-finite component, take no
part. Rows of one id count once, with the smallest label and then the smallest
vector. Vectors of different lengths have no score together. Scores are longs;
vectors must be such that they fit. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import durable

POSITIVES = 5
NEGATIVES = 3
# A window reaches from LOW to HIGH percent of its positive's score.
LOW = 50
HIGH = 95
# Doubles of a block of rows, and anchors that meet it at once.
BLOCK_BYTES = 8 << 20
ANCHORS = 256
BLOCKS_PER_CORE = 4

_NONE = np.iinfo(np.int64).min
_EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; `x` holds floor(scale * component) as doubles."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    ).where(finite)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"),
    )


# --- blocks ------------------------------------------------------------------


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if largest < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def ordered(scores: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, int]:
    """One long for each allowed score that sorts by score and then by later column; the others sort first."""
    shift = max(1, int(scores.shape[1]).bit_length())
    if scores.size and max(abs(int(scores.max())), abs(int(scores.min()))) >= 1 << (62 - shift):
        raise OverflowError("scores too large to be ordered with their rows")
    packed = (scores << shift) + np.arange(scores.shape[1] - 1, -1, -1)
    return np.where(allowed, packed, _NONE), shift


def best(scores: np.ndarray, allowed: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the `many` largest allowed scores of each row; ties go to the earlier column."""
    packed, shift = ordered(scores, allowed)
    if packed.shape[1] > many:
        packed = np.partition(packed, -many, axis=1)[:, -many:]
    row, place = np.nonzero(packed != _NONE)
    return row, scores.shape[1] - 1 - (packed[row, place] & ((1 << shift) - 1))


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Smallest and largest whole score from `low` to `high` percent of `score`."""
    return -(-low * score // 100), high * score // 100


def in_windows(scores: np.ndarray, allowed: np.ndarray, windows: list[list[tuple[int, int]]], many: int):
    """Row and column of the `many` largest allowed scores in each window of a row, each column once."""
    packed, shift = ordered(scores, allowed)
    packed.sort(axis=1)
    rows, columns = [], []
    for number, line in enumerate(packed):
        chosen: set[int] = set()
        for low, high in windows[number]:
            end = int(np.searchsorted(line, (high + 1) << shift))
            begin = max(end - many, int(np.searchsorted(line, low << shift)))
            chosen.update(line[begin:end].tolist())
        rows += [number] * len(chosen)
        columns += [scores.shape[1] - 1 - (value & ((1 << shift) - 1)) for value in sorted(chosen)]
    return np.array(rows, np.int64), np.array(columns, np.int64)


_FOUND = pa.schema([("anchor_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _meetings(batches: Iterator[pa.RecordBatch]):
    """(anchors' ids, labels, wanted scores, rows' ids, labels, scores) of every block and few anchors.

    The rows of a block come first, in the order of their ids, then the anchors.
    """
    block, held, sides = None, [], {}
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for low, high in zip([0, *edges], [*edges, batch.num_rows]):
            if high == low:
                continue
            part = batch.slice(low, high - low)
            if blocks[low] != block:
                block, held, sides = blocks[low], [], {}
            if kinds[low] == 0:
                held.append(part)
                continue
            if held:
                sides, held = _by_length(pa.Table.from_batches(held)), []
            for start in range(0, part.num_rows, ANCHORS):
                anchors = _by_length(pa.Table.from_batches([part.slice(start, ANCHORS)]))
                for length, (ids, labels, x, wanted) in anchors.items():
                    if length in sides:
                        other_ids, other_labels, rows, _ = sides[length]
                        yield ids, labels, wanted, other_ids, other_labels, products(x, rows)


def _by_length(rows: pa.Table) -> dict[int, tuple]:
    """ids, labels, matrix and wanted scores of the vectors of each length."""
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    x = rows.column("x").combine_chunks()
    lengths = x.value_lengths().to_numpy()
    flat = x.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    wanted = rows.column("wanted").to_pylist()
    sides = {}
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        matrix = flat[starts[at][:, None] + np.arange(length)]
        sides[length] = ids[at], labels[at], matrix, [wanted[n] for n in at.tolist()]
    return sides


def _found(anchor_ids, ids, scores, row, column) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor_ids[row]), pa.array(ids[column]), pa.array(scores[row, column])], schema=_FOUND
    )


def _positives_of_blocks(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor_ids, labels, _, ids, other_labels, scores in _meetings(batches):
            allowed = (labels[:, None] == other_labels) & (anchor_ids[:, None] != ids)
            yield _found(anchor_ids, ids, scores, *best(scores, allowed, many))

    return run


def _negatives_of_blocks(many: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor_ids, labels, wanted, ids, other_labels, scores in _meetings(batches):
            windows = [[window(score, low, high) for score in set(own)] for own in wanted]
            allowed = (labels[:, None] != other_labels) & (anchor_ids[:, None] != ids)
            yield _found(anchor_ids, ids, scores, *in_windows(scores, allowed, windows, many))

    return run


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, run) -> DataFrame:
    """Every anchor with every block of rows."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    nothing = F.array().cast("array<bigint>")
    left = rows.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "x", nothing.alias("wanted"))
    right = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label",
        "x", "wanted",
    )
    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")
    return dealt.mapInArrow(run, "anchor_id long, id long, score long")


# --- secondary sort ----------------------------------------------------------

_KEY = struct.Struct(">QQQ")
_MIDDLE = 1 << 63


def key(anchor: int, score: int, name: int) -> bytes:
    """Bytes that sort by anchor, then descending score, then id."""
    return _KEY.pack(anchor + _MIDDLE, _MIDDLE - 1 - score, name + _MIDDLE)


def unpacked(packed: bytes) -> tuple[int, int, int]:
    anchor, score, name = _KEY.unpack(packed)
    return anchor - _MIDDLE, _MIDDLE - 1 - score, name - _MIDDLE


def part_of(packed: bytes) -> int:
    """All keys of an anchor belong to one part."""
    return zlib.crc32(packed[:8])


def streamed(entries: Iterator[tuple[bytes, bool]], many: int = NEGATIVES, low: int = LOW, high: int = HIGH):
    """Negatives of each positive from (key, whether positive) in the order of keys.

    Holds the windows open for the current anchor and the first negatives of the
    current score, since a positive may share its score with negatives of smaller
    ids that belong to its window.
    """
    current, level, same, windows = None, None, [], []
    for packed, positive in entries:
        anchor, score, name = unpacked(packed)
        if anchor != current:
            current, level, windows = anchor, None, []
        if score != level:
            level, same = score, []
        if positive:
            least, most = window(score, low, high)
            opened = [name, score, least, most, 0]
            windows.append(opened)
            for earlier in same:
                if least <= score <= most:
                    opened[4] += 1
                    yield anchor, name, opened[4], earlier, score, score
            continue
        if len(same) < many:
            same.append(name)
        for opened in windows:
            if opened[2] <= score <= opened[3] and opened[4] < many:
                opened[4] += 1
                yield anchor, opened[0], opened[4], name, opened[1], score
        windows = [opened for opened in windows if opened[4] < many and score >= opened[2]]


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine(
    rows: DataFrame,
    every: int,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """The hardest negatives of each anchor and positive.

    `rows` has (vec_id, label, x) with whole numbers in `x`; anchors are the rows
    whose id is divisible by `every`. An anchor's positives are its `positives`
    best other rows of its label, by inner product and then smaller id. For each,
    the first `negatives` rows of other labels are given, in the same order, whose
    score is from `low` to `high` percent of the positive's.
    """
    spark = rows.sparkSession
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*")
    stored = durable(once, "vectors")
    bound = stored.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("length")).first()
    blocks = max(
        BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism,
        math.ceil(bound["n"] * bound["length"] * 8 / BLOCK_BYTES),
    )
    anchors = stored.where(F.col("vec_id") % every == 0)

    found = _met(
        stored, anchors.withColumn("wanted", F.array().cast("array<bigint>")), blocks, _positives_of_blocks(positives)
    )
    ranking = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    first = durable(
        found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= positives).drop("rank"),
        "positives",
    )
    wanted = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("wanted"))
    below = _met(stored, anchors.join(wanted, "vec_id"), blocks, _negatives_of_blocks(negatives, low, high))

    entries = first.withColumn("positive", F.lit(True)).unionByName(below.withColumn("positive", F.lit(False)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = entries.rdd.map(lambda row: (key(row["anchor_id"], row["score"], row["id"]), row["positive"]))
    ranked = keyed.repartitionAndSortWithinPartitions(parts, part_of).mapPartitions(
        lambda part: streamed(part, negatives, low, high)
    )
    return spark.createDataFrame(ranked, RESULT, verifySchema=False)
