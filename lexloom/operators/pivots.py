"""Exact nearest vectors with blocks around pivots.

Vectors are unit vectors, or zero. Each belongs to the block of its nearest pivot;
a block's radius is the largest angle between its vectors and the pivot. A query
first meets the nearest blocks that hold enough vectors, which gives it a score to
beat. By the triangle inequality no vector of a block is nearer to a query than
the angle to the pivot less the radius; blocks that cannot beat the score are
never met. The result is exact, whatever the vectors; how many blocks are skipped
depends on how much they cluster. Pivots are spread over a bounded sample.

Blocks lie on shelves of bounded size. A query is sent once to a shelf, with the
list of the blocks that it meets there, and brings back its best of the whole shelf. A
block larger than a shelf is dealt into parts, and the queries of a shelf into groups, so
that no task holds more than a part of the vectors and few queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import durable

MAX_PIVOTS = 4_096
PIVOT_ROWS = 256
SAMPLE_PER_PIVOT = 8
# Vectors of a shelf and their bytes, queries of a shelf in one group, queries multiplied at once.
BLOCK_ROWS = 65_536
SHELF_BYTES = 64 * 1024 * 1024
GROUP_ROWS = 65_536
QUERY_ROWS = 512
# Scores are compared to this many digits; angles are trusted to ANGLE_ERROR.
DIGITS = 6
ANGLE_ERROR = 1e-6
_UNIT = 10**DIGITS
_NONE = np.iinfo(np.int64).min


class Blocks(NamedTuple):
    """Pivots as rows, and of each block the radius and number of vectors; the last block holds zero vectors."""

    pivots: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest cosine that a vector of each block can have with each query."""
        angles = np.arccos(np.clip(queries @ self.pivots.T, -1, 1)) - self.radius[:-1] - ANGLE_ERROR
        found = np.concatenate([np.cos(np.maximum(angles, 0)), np.zeros((len(queries), 1))], axis=1)
        # A zero query scores 0 everywhere.
        return np.where((queries == 0).all(axis=1)[:, None], np.maximum(found, 0), found)

    def home(self, queries: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
        """Of each query the blocks with the highest bounds that hold `many` vectors, its nearest pivot first."""
        likely = np.concatenate([queries @ self.pivots.T, np.full((len(queries), 1), -2.0)], axis=1)
        order = np.argsort(-likely, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        last = np.minimum((held < many[:, None]).sum(axis=1), len(self.rows) - 1)
        return [line[: end + 1] for line, end in zip(order, last)]


def spread_pivots(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows of `sample` far from each other: each next one is the farthest from those before."""
    if not len(sample):
        return np.zeros((0, 0))
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(many, len(sample)):
        at = int(nearest.argmin())
        if nearest[at] >= 1 - 1e-12:
            break
        chosen.append(at)
        nearest = np.maximum(nearest, sample @ sample[at])
    return sample[chosen]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def blocks_of(vectors: DataFrame, name: str = "token") -> tuple[DataFrame, Blocks]:
    """(`name`, vec, block), stored, and its blocks."""
    spark = vectors.sparkSession
    # The check of a zero vector is exact: unit vectors have no other.
    nonzero = F.exists("vec", lambda v: v != 0)
    many = min(MAX_PIVOTS, math.ceil(vectors.count() / PIVOT_ROWS) + 1)
    drawn = vectors.where(nonzero).select("vec", name).orderBy(F.xxhash64(F.lit(1), name), name)
    sample = np.array([row["vec"] for row in drawn.limit(SAMPLE_PER_PIVOT * many).collect()], float)
    pivots = spread_pivots(sample, many)
    shared = spark.sparkContext.broadcast(pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, QUERY_ROWS):
            x = _matrix(piece.column("vec"))
            zero = (x == 0).all(axis=1)
            # Rows of zeros may meet no pivot at all.
            cosines = x @ shared.value.T if len(shared.value) else np.zeros((len(x), 1))
            block = np.where(zero, len(shared.value), cosines.argmax(axis=1)).astype(np.int32)
            angle = np.where(zero, 0, np.arccos(np.clip(cosines.max(axis=1), -1, 1)))
            yield pa.RecordBatch.from_arrays(
                [piece.column(name), piece.column("vec"), pa.array(block), pa.array(angle)],
                names=[name, "vec", "block", "angle"],
            )

    stored = durable(
        vectors.select(name, "vec").mapInArrow(assigned, f"{name} string, vec array<double>, block int, angle double"),
        "blocks",
    )
    radius, rows = np.zeros(len(pivots) + 1), np.zeros(len(pivots) + 1, np.int64)
    # At most MAX_PIVOTS rows and one.
    for row in stored.groupBy("block").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect():
        radius[row["block"]], rows[row["block"]] = row["angle"], row["n"]
    return stored, Blocks(pivots, radius, rows)


def _with_blocks(queries: DataFrame, blocks: Blocks, choose, column: str) -> DataFrame:
    """`queries` and a column with the blocks that `choose(blocks, x, rows)` gives for each."""
    shared = queries.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, QUERY_ROWS):
            x = _matrix(piece.column("vec"))
            chosen = choose(shared.value, x if len(shared.value.pivots) else x[:, :0], piece)
            lists = pa.array([line.tolist() for line in chosen], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("query"), piece.column("vec"), piece.column("excluded"), lists],
                names=["query", "vec", "excluded", column],
            )

    return queries.mapInArrow(run, f"query string, vec array<double>, excluded array<string>, {column} array<int>")


def home_blocks(queries: DataFrame, blocks: Blocks, topn: int) -> DataFrame:
    """(query, vec, excluded, met): the blocks that each query meets first."""

    def choose(known: Blocks, x: np.ndarray, piece: pa.RecordBatch) -> list[np.ndarray]:
        return known.home(x, piece.column("excluded").value_lengths().fill_null(0).to_numpy() + topn)

    return _with_blocks(queries, blocks, choose, "met")


def further_blocks(queries: DataFrame, blocks: Blocks) -> DataFrame:
    """(query, vec, excluded, blocks): those not `met` that may hold vectors as near as the `least` score of a query."""

    def choose(known: Blocks, x: np.ndarray, piece: pa.RecordBatch) -> list[np.ndarray]:
        least = piece.column("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
        open_ = (known.bounds(x) + 2 / _UNIT >= least[:, None]) & (known.rows > 0)
        for row, seen in enumerate(piece.column("met").to_pylist()):
            open_[row, seen] = False
        return [np.flatnonzero(line) for line in open_]

    return _with_blocks(queries, blocks, choose, "blocks")


# --- meetings ----------------------------------------------------------------

_WINNERS = pa.schema([("query", pa.string()), ("token", pa.string()), ("score", pa.float64())])


def best(scores: np.ndarray, allowed: np.ndarray, topn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the `topn` best allowed entries; equal ones by column."""
    shift = max(1, int(scores.shape[1]).bit_length())
    units = np.rint(scores * _UNIT).astype(np.int64)
    packed = np.where(allowed, (units << shift) + np.arange(scores.shape[1] - 1, -1, -1), _NONE)
    if packed.shape[1] > topn:
        packed = np.partition(packed, -topn, axis=1)[:, -topn:]
    row, place = np.nonzero(packed != _NONE)
    found = packed[row, place]
    return row, scores.shape[1] - 1 - (found & ((1 << shift) - 1)), (found >> shift) / _UNIT


def _banned(queries: pa.RecordBatch, position: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of the excluded tokens that are held."""
    found = [
        (row, position[token])
        for row, tokens in enumerate(queries.column("excluded").to_pylist())
        for token in tokens or []
        if token in position
    ]
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _met_on_shelf(queries: pa.RecordBatch, words: np.ndarray, block: np.ndarray, rank: np.ndarray, banned, topn: int):
    """Query row, word and score of the best for each query, over the blocks that it names; words lie block by block."""
    x = _matrix(queries.column("vec"))
    lists = queries.column("blocks")
    asked, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for name in np.unique(asked):
        low, high = np.searchsorted(block, [name, name + 1])
        if low == high:
            continue
        rows = np.unique(of[asked == name])
        scores = x[rows] @ words[low:high].T
        allowed = np.ones(scores.shape, bool)
        here = (banned[1] >= low) & (banned[1] < high) & np.isin(banned[0], rows)
        allowed[np.searchsorted(rows, banned[0][here]), banned[1][here] - low] = False
        row, column, score = best(scores, allowed, topn)
        found.append((rows[row], column + low, score))
    row, column, score = (np.concatenate(parts) for parts in zip(*found))
    order = np.lexsort((rank[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < topn
    return row[kept], column[kept], score[kept]


def _meet(topn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tokens, words, block, rank, position = None, [], None, None, None, None, {}
        for batch in batches:
            keys = np.column_stack([batch.column(name).to_numpy() for name in ("shelf", "part", "group", "kind")])
            cuts = np.flatnonzero(np.append(True, (np.diff(keys, axis=0) != 0).any(axis=1))[: len(keys)]).tolist()
            for low, high in zip(cuts, cuts[1:] + [batch.num_rows]):
                part = batch.slice(low, high - low)
                if tuple(keys[low, :3]) != place:
                    place, held, words = tuple(keys[low, :3]), [], None
                if keys[low, 3] == 0:
                    held.append(part)
                    continue
                if words is None and held:
                    table = pa.Table.from_batches(held)
                    tokens, words = table.column("name").combine_chunks(), _matrix(table.column("vec").combine_chunks())
                    block, names = table.column("block").to_numpy(), tokens.to_pylist()
                    rank = np.empty(len(names), np.int64)
                    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                    position, held = {token: n for n, token in enumerate(names)}, []
                if words is None:
                    continue
                for queries in _pieces(iter([part]), QUERY_ROWS):
                    row, column, score = _met_on_shelf(queries, words, block, rank, _banned(queries, position), topn)
                    yield pa.RecordBatch.from_arrays(
                        [queries.column("name").take(pa.array(row)), tokens.take(pa.array(column)), pa.array(score)],
                        schema=_WINNERS,
                    )

    return run


def _room(blocks: Blocks, tasks: int) -> int:
    """Vectors on a shelf: bounded, and fewer in a small table, so that few copies of either side give all tasks work."""
    bound = min(BLOCK_ROWS, SHELF_BYTES // (8 * max(1, blocks.pivots.shape[1])))
    return max(1, min(bound, math.ceil(blocks.rows.sum() / math.sqrt(tasks))))


def _shelves(blocks: Blocks, limit: int) -> np.ndarray:
    """Of each block its shelf: neighbours share one while they fit."""
    found, held = np.zeros(len(blocks.rows), np.int32), 0
    for block, rows in enumerate(blocks.rows.tolist()):
        new = block > 0 and held + rows > limit
        found[block] = found[block - 1] + new if block else 0
        held = rows if new else held + rows
    return found


def _by_shelf(shelves: np.ndarray):
    """A row for each query and shelf, with the blocks it meets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, QUERY_ROWS):
            lists = piece.column("blocks")
            named = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            order = np.lexsort((named, shelves[named], row))
            row, named = row[order], named[order]
            shelf = shelves[named]
            starts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(shelf) != 0))[: len(row)])
            ends = pa.array(np.append(starts, len(row)).astype(np.int32))
            at = pa.array(row[starts])
            yield pa.RecordBatch.from_arrays(
                [piece.column(name).take(at) for name in ("query", "vec", "excluded")]
                + [pa.array(shelf[starts]), pa.ListArray.from_arrays(ends, pa.array(named.astype(np.int32)))],
                names=["query", "vec", "excluded", "shelf", "blocks"],
            )

    return run


def met_lists(wanted: DataFrame, stored: DataFrame, blocks: Blocks, topn: int) -> DataFrame:
    """(query, token, score) of the best vectors on each shelf for rows of a stored table (query, vec, excluded, blocks)."""
    spark = wanted.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = _room(blocks, tasks)
    shelves = _shelves(blocks, limit)
    held = np.bincount(shelves, weights=blocks.rows).astype(np.int64)
    schema = "query string, vec array<double>, excluded array<string>, shelf int, blocks array<int>"
    asked = wanted.select("query", "vec", "excluded", "blocks").mapInArrow(_by_shelf(shelves), schema)
    # At most a row for each shelf. Few shelves have their queries in more groups, so that all tasks have work.
    needed = {row["shelf"]: row["n"] for row in asked.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    parts = {shelf: -(-int(held[shelf]) // limit) for shelf in needed if held[shelf]}
    least = -(-tasks // max(1, sum(parts.values())))
    dealt = spark.createDataFrame(
        [(shelf, many, max(least, -(-needed[shelf] // GROUP_ROWS))) for shelf, many in parts.items()],
        "shelf int, parts int, groups int",
    )
    placed = spark.createDataFrame([(n, int(shelf)) for n, shelf in enumerate(shelves)], "block int, shelf int")

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def one_of(name: str, count: str):
        return F.pmod(F.xxhash64(name), F.col(count)).cast("int")

    words = stored.join(F.broadcast(placed.join(dealt, "shelf")), "block").select(
        "shelf", one_of("token", "parts").alias("part"), all_of("groups").alias("group"), F.lit(0).alias("kind"), "block",
        F.col("token").alias("name"), "vec", F.array().cast("array<string>").alias("excluded"),
        F.array().cast("array<int>").alias("blocks"),
    )
    queries = asked.join(F.broadcast(dealt), "shelf").select(
        "shelf", all_of("parts").alias("part"), one_of("query", "groups").alias("group"), F.lit(1).alias("kind"),
        F.lit(0).alias("block"), F.col("query").alias("name"), "vec", "excluded", "blocks",
    )
    together = words.unionByName(queries).repartition(tasks, "shelf", "part", "group")
    ordered = together.sortWithinPartitions("shelf", "part", "group", "kind", "block", "name")
    return ordered.mapInArrow(_meet(topn), "query string, token string, score double")


def met(wanted: DataFrame, stored: DataFrame, blocks: Blocks, topn: int) -> DataFrame:
    """As `met_lists`, for rows of one block each (query, vec, excluded, block)."""
    return met_lists(wanted.withColumn("blocks", F.array("block")), stored, blocks, topn)


def ranked(winners: DataFrame, topn: int) -> DataFrame:
    ranking = Window.partitionBy("query").orderBy(F.desc("score"), "token")
    return winners.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= topn)


def nearest(queries: DataFrame, vectors: DataFrame, topn: int = 10) -> DataFrame:
    """(query, token, score, rank): the `topn` tokens of highest cosine for each query.

    `queries` has (query, vec, excluded), each query once, and `vectors` (token,
    vec); vectors have length one or zero. Equal scores, to DIGITS digits, go by
    token.
    """
    stored, blocks = blocks_of(vectors)
    home = durable(home_blocks(queries.select("query", "vec", "excluded"), blocks, topn), "home")
    first = met_lists(home.withColumnRenamed("met", "blocks"), stored, blocks, topn)
    first = durable(ranked(first, topn), "first")
    least = first.where(F.col("rank") == topn).select("query", F.col("score").alias("least"))
    more = durable(further_blocks(home.join(least, "query", "left"), blocks), "further")
    both = first.drop("rank").unionByName(
        met_lists(more, stored, blocks, topn)
    )
    return ranked(both, topn)
