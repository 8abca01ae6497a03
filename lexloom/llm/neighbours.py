"""Approximate nearest neighbours by a forest of random-projection trees.

A tree has one random direction for each level and cuts every node of a level at
its median along that direction. The depth grows with the table, so that leaves
keep about `LEAF_VECTORS` vectors; directions and cuts are fitted on a bounded
sample, and every vector is put into one leaf of each tree. A query goes down all
trees with one shared priority queue, nearest cuts first. The vectors of the
leaves it visits are ranked by their exact inner product.

How many leaves are visited is measured, not guessed: the true neighbours of a
few queries are found in one pass over the table, and the smallest number of
visits that meets `RECALL` of them is used for all queries. Clustered vectors
need few leaves, vectors without structure many.

Trees cut the vectors as they are, without the component that turns inner products
into distances: with it queries lie far from their own cluster where lengths differ.
The measured number of visits answers for lengths too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import durable

NEIGHBOURS = 20
TREES = 8
# Vectors of the table that a leaf is meant to hold.
LEAF_VECTORS = 256
# Cuts are medians of at most SAMPLE_VECTORS vectors, SAMPLE_OF_LEAF of them for each leaf.
SAMPLE_VECTORS = 65_536
SAMPLE_OF_LEAF = 16
# Share of the true neighbours of JUDGES queries that the visited leaves must hold.
RECALL = 0.97
JUDGES = 128
# A query meets the leaves below one node of this height in one task, vectors in blocks.
GROUP_LEVELS = 6
BLOCK_VECTORS = 16_384
QUERIES_AT_ONCE = 128
_HASH_RANGE = 1 << 30
_EPSILON = float(np.finfo(float).eps)


class Forest(NamedTuple):
    """Directions by tree and level; cuts by tree, nodes numbered level by level."""

    depth: int
    directions: np.ndarray
    cuts: list[list[float]]


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """Distinct `vec_id` and `x` (doubles) of vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(
        finite & F.exists(x, lambda v: v != 0)
    )
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v + 0.0).alias("x"))
    return kept if dimension is None else kept.where(F.size("x") == dimension)


def depth_for(vectors: int) -> int:
    """Levels that bring leaves to LEAF_VECTORS, as far as the sample can carry them."""
    levels = 0
    while vectors > LEAF_VECTORS << levels and SAMPLE_OF_LEAF << (levels + 1) <= SAMPLE_VECTORS:
        levels += 1
    return levels


def fit(sample: np.ndarray, depth: int) -> Forest:
    """Trees of `depth` levels, cut at the medians of the sample."""
    directions = np.zeros((TREES, depth, sample.shape[1]))
    cuts = []
    for tree in range(TREES):
        rng = np.random.default_rng(1000 + tree)
        node = np.zeros(len(sample), np.int64)
        mine: list[float] = []
        for level in range(depth):
            direction = rng.normal(size=sample.shape[1])
            directions[tree, level] = direction / np.linalg.norm(direction)
            along = sample @ directions[tree, level]
            order = np.lexsort((along, node))
            bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
            middle = (bounds[:-1] + bounds[1:] - 1) // 2
            filled = bounds[1:] > bounds[:-1]
            median = np.where(filled, along[order][np.minimum(middle, len(sample) - 1)], 0.0) if len(sample) else np.zeros(1 << level)
            mine += median.tolist()
            node = 2 * node + (along > median[node])
        cuts.append(mine)
    return Forest(depth, directions, cuts)


def leaves_of(forest: Forest, tree: int, points: np.ndarray) -> np.ndarray:
    """Leaf number of every point in a tree."""
    along = points @ forest.directions[tree].T
    cuts = np.array(forest.cuts[tree])
    node = np.zeros(len(points), np.int64)
    for level in range(forest.depth):
        node = 2 * node + (along[:, level] > cuts[(1 << level) - 1 + node])
    return node


def visited(forest: Forest, query: np.ndarray, visits: int, counts: list[dict[int, int]], least: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees: what crosses the least comes first.

    Goes on beyond `visits` until the leaves of some tree hold `least` vectors.
    """
    along = (forest.directions @ query).tolist()
    queue = [(0.0, tree, 0, 0) for tree in range(TREES)]
    held = [0] * TREES
    found = []
    while queue and (len(found) < visits or max(held) < least):
        crossed, tree, level, node = heapq.heappop(queue)
        if level == forest.depth:
            found.append((tree, node))
            held[tree] += counts[tree].get(node, 0)
            continue
        margin = along[tree][level] - forest.cuts[tree][(1 << level) - 1 + node]
        near = 2 * node + (margin > 0)
        heapq.heappush(queue, (crossed, tree, level + 1, near))
        heapq.heappush(queue, (crossed + margin * margin, tree, level + 1, near ^ 1))
    return found


def crossings(forest: Forest, query: np.ndarray) -> np.ndarray:
    """By tree and leaf, what the queue of `visited` orders leaves by."""
    along = forest.directions @ query
    crossed = np.zeros((TREES, 1))
    for level in range(forest.depth):
        cuts = np.array([mine[(1 << level) - 1 : (2 << level) - 1] for mine in forest.cuts])
        margin = along[:, level, None] - cuts
        below = crossed + np.where(margin > 0, margin * margin, 0.0)
        above = crossed + np.where(margin > 0, 0.0, margin * margin)
        crossed = np.stack([below, above], axis=2).reshape(TREES, -1)
    return crossed


def visits_needed(forest: Forest, queries: list[np.ndarray], neighbours: list[np.ndarray], recall: float = RECALL) -> int:
    """The smallest number of visits whose leaves hold that share of the neighbours."""
    ranks = []
    for query, near in zip(queries, neighbours, strict=True):
        if len(near):
            crossed = crossings(forest, query)
            own = np.min([crossed[tree, leaves_of(forest, tree, near)] for tree in range(TREES)], axis=0)
            ranks.append(np.searchsorted(np.sort(crossed.ravel()), own, side="right"))
    if not ranks:
        return TREES
    every = np.sort(np.concatenate(ranks))
    return max(TREES, int(every[int(np.ceil(recall * len(every))) - 1]))


_CELL = "cell long, block long, kind int, id long, leaves binary, ids binary, x binary"
_CELL_SCHEMA = pa.schema(
    [
        ("cell", pa.int64()),
        ("block", pa.int64()),
        ("kind", pa.int32()),
        ("id", pa.int64()),
        ("leaves", pa.binary()),
        ("ids", pa.binary()),
        ("x", pa.binary()),
    ]
)
_CELLS = 1 << 32


def _group_shift(forest: Forest) -> int:
    return min(forest.depth, GROUP_LEVELS)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _entry_rows(shared):
    """A row for each vector and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, blocks = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1_000):
                part = batch.slice(low, 1_000)
                x = _matrix(part.column("x"))
                ids = [np.array(v, np.int64).tobytes() for v in part.column("ids").to_pylist()]
                raw = [row.tobytes() for row in x]
                spread = part.column("spread").to_numpy()
                for tree in range(TREES):
                    leaf = leaves_of(forest, tree, x)
                    cell = (leaf >> _group_shift(forest)) + tree * _CELLS
                    count = np.array([blocks.get(c, 1) for c in cell.tolist()])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell),
                            pa.array(spread % count),
                            pa.array(np.zeros(len(x), np.int32)),
                            pa.array(np.zeros(len(x), np.int64)),
                            pa.array([n.tobytes() for n in leaf.astype(np.int32)], pa.binary()),
                            pa.array(ids, pa.binary()),
                            pa.array(raw, pa.binary()),
                        ],
                        schema=_CELL_SCHEMA,
                    )

    return run


def _cell_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            cells = [leaves_of(forest, tree, x) + tree * _CELLS for tree in range(TREES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells))], names=["cell"])

    return run


def _judge_rows(shared, k: int):
    """Of the vectors of a task the best `k` of each judging query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, judges = shared.value
        best = [(np.zeros(0), np.zeros((0, judges.shape[1]))) for _ in numbers]
        for batch in batches:
            for low in range(0, batch.num_rows, 4_096):
                part = batch.slice(low, 4_096)
                x = _matrix(part.column("x"))
                ids = part.column("ids").to_pylist()
                products = judges @ x.T
                alone = {mine[0]: at for at, mine in enumerate(ids) if len(mine) == 1}
                for at, number in enumerate(numbers):
                    row = products[at]
                    if number in alone:
                        row[alone[number]] = -np.inf
                    take = np.argsort(-row)[:k]
                    take = take[row[take] > -np.inf]
                    scores = np.concatenate([best[at][0], row[take]])
                    order = np.argsort(-scores, kind="stable")[:k]
                    best[at] = scores[order], np.concatenate([best[at][1], x[take]])[order]
        at = [n for n, (scores, _) in enumerate(best) for _ in scores]
        if at:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at, pa.int32()),
                    pa.array(np.concatenate([scores for scores, _ in best])),
                    pa.array([row.tobytes() for _, rows in best for row in rows], pa.binary()),
                ],
                names=["judge", "score", "x"],
            )

    return run


def calibrated(groups: DataFrame, queries: DataFrame, forest: Forest, k: int) -> int:
    """Visits that meet RECALL of the `k` nearest vectors of JUDGES queries, chosen by a hash of their id."""
    judges = queries.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(JUDGES).collect()
    if not judges or not forest.depth:
        return TREES
    spark = groups.sparkSession
    points = np.array([r.x for r in judges])
    shared = spark.sparkContext.broadcast(([r.vec_id for r in judges], points))
    order = Window.partitionBy("judge").orderBy(F.desc("score"), "x")
    near = (
        groups.select("ids", "x")
        .mapInArrow(_judge_rows(shared, k), "judge int, score double, x binary")
        .withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") <= k)
        .collect()
    )
    found: list[list[np.ndarray]] = [[] for _ in judges]
    for r in near:
        found[r.judge].append(np.frombuffer(r.x, np.float64))
    return visits_needed(forest, list(points), [np.array(rows).reshape(len(rows), points.shape[1]) for rows in found])


def _visit_rows(shared):
    """A row for each query, node whose leaves it visits and block of that node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, counts, blocks, visits, least = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"))
            for query, row in zip(batch.column("vec_id").to_pylist(), x, strict=True):
                mine: dict[int, list[int]] = {}
                for tree, leaf in visited(forest, row, visits, counts, least):
                    mine.setdefault(tree * _CELLS + (leaf >> _group_shift(forest)), []).append(leaf)
                places = [(cell, block) for cell in mine for block in range(blocks.get(cell, 0))]
                if not places:
                    continue
                count = len(places)
                leaves = {cell: np.array(sorted(found), np.int32).tobytes() for cell, found in mine.items()}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c for c, _ in places], pa.int64()),
                        pa.array([b for _, b in places], pa.int64()),
                        pa.array([1] * count, pa.int32()),
                        pa.array([query] * count, pa.int64()),
                        pa.array([leaves[c] for c, _ in places], pa.binary()),
                        pa.nulls(count, pa.binary()),
                        pa.array([row.tobytes()] * count, pa.binary()),
                    ],
                    schema=_CELL_SCHEMA,
                )

    return run


def exact_products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first component to the last, whatever the shapes."""
    return np.add.accumulate(vectors * query, axis=1)[:, -1] + 0.0


def best_of_each(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id once with its best score; best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])
    return ids[first], scores[first]


def nearest_of(
    query: int, x: np.ndarray, estimates: np.ndarray, matrix: np.ndarray, longest: float, ids: list[np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids of one query, ties to the smaller id, without the query itself.

    `estimates` are products that may be summed in any order, minus infinity for
    vectors that the query does not meet; whatever rounding could lift among the
    best is scored exactly. `longest` is the greatest length of a vector.
    """
    slack = 4 * len(x) * _EPSILON * np.linalg.norm(x) * longest
    met = np.flatnonzero(estimates > -np.inf)
    estimates = estimates[met]
    take = min(k + 1, len(met))
    while True:
        floor = np.partition(estimates, len(estimates) - take)[len(estimates) - take] - slack
        chosen = met[estimates >= floor]
        scores = exact_products(x, matrix[chosen])
        every = np.concatenate([ids[n] for n in chosen])
        values = np.repeat(scores, [len(ids[n]) for n in chosen])
        other = every != query
        every, values = best_of_each(every[other], values[other])
        # What was not chosen scores less; ids with several vectors may leave too few of them.
        if len(every) >= k or take == len(met):
            return every[:k], values[:k]
        take = min(2 * take, len(met))


def _ranked_rows(k: int):
    """Per query and block of a node the best candidates; a block's vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, rows, leaves, matrix, longest, bounds, waiting, out = None, [], [], [], None, 0.0, {}, [], []

        def arranged():
            """Vectors in the order of their leaves."""
            nonlocal ids, matrix, longest, bounds
            order = np.argsort(leaves, kind="stable")
            ids = [ids[n] for n in order]
            matrix = np.stack([rows[n] for n in order])
            longest = float(np.sqrt((matrix * matrix).sum(axis=1).max()))
            found, start = np.unique(np.array(leaves)[order], return_index=True)
            bounds = dict(zip(found.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(ids)], strict=True), strict=True))

        def settled():
            if waiting and rows:
                if matrix is None:
                    arranged()
                points = np.stack([x for _, _, x in waiting])
                asking: dict[int, list[int]] = {}
                for at, (_, mine, _) in enumerate(waiting):
                    for leaf in mine:
                        asking.setdefault(leaf, []).append(at)
                estimates = np.full((len(waiting), len(ids)), -np.inf)
                for leaf, queries in asking.items():
                    if leaf in bounds:
                        low, high = bounds[leaf]
                        estimates[queries, low:high] = points[queries] @ matrix[low:high].T
                for (query, _, x), mine in zip(waiting, estimates, strict=True):
                    if mine.max() > -np.inf:
                        found, values = nearest_of(query, x, mine, matrix, longest, ids, k)
                        out.append((query, found.tobytes(), values.tobytes()))
            waiting.clear()

        def emitted():
            columns = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                names=["query_id", "ids", "scores"],
            )
            out.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cell", "block", "kind", "id", "leaves", "ids", "x"))
            for cell, block, kind, query, met, mine, raw in zip(*columns, strict=True):
                if (cell, block) != current:
                    settled()
                    current, ids, rows, leaves, matrix = (cell, block), [], [], [], None
                places = np.frombuffer(met, np.int32)
                if kind == 0:
                    ids.append(np.frombuffer(mine, np.int64))
                    rows.append(np.frombuffer(raw, np.float64))
                    leaves.append(int(places[0]))
                else:
                    waiting.append((query, places.tolist(), np.frombuffer(raw, np.float64)))
                    if len(waiting) == QUERIES_AT_ONCE:
                        settled()
            if len(out) > 5_000:
                yield emitted()
        settled()
        if out:
            yield emitted()

    return run


def _merged_rows(k: int):
    """The best of all leaves of each query; a query's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []

        def settled():
            if not held:
                return
            ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in held])
            scores = np.concatenate([np.frombuffer(s, np.float64) for _, s in held])
            ids, scores = best_of_each(ids, scores)
            best = zip(ids[:k].tolist(), scores[:k].tolist(), strict=True)
            out.extend((current, rank, n, score) for rank, (n, score) in enumerate(best, 1))
            held[:] = []

        def emitted():
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                names=["query_id", "rank", "vec_id", "score"],
            )
            out.clear()
            return batch

        for batch in batches:
            for query, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("query_id", "ids", "scores")), strict=True):
                if query != current:
                    settled()
                    current = query
                held.append((ids, scores))
            if len(out) > 10_000:
                yield emitted()
        settled()
        if out:
            yield emitted()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, visits: int | None = None) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `k` nearest found of each query.

    Both take `vec_id` and `embedding`. Vectors without id, null, zero or with
    null or non-finite components take no part, nor do those whose length is not
    the commonest one. Candidates are all vectors but those with the query's own
    id; repeated rows count once. An id with several vectors is one candidate, or
    one query, with the best score of them. Equal vectors are searched as one with its
    smallest `k + 1` ids, which is all that can be among the nearest. Scores are
    inner products in double precision, ties go to the smaller id.

    `visits` is the number of leaves a query visits, by default what `calibrated`
    measures; as many as there are leaves (TREES << depth_for(vectors)) is exact.
    A query goes on until it has met `k + 1` different vectors, if there are so many.
    """
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = usable(vectors).groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = common.n if common else 0
    mine = usable(vectors, dimension).distinct()
    asked = usable(queries, dimension).distinct()
    first = Window.partitionBy("x").orderBy("vec_id")
    groups = (
        mine.withColumn("_nth", F.row_number().over(first))
        .where(F.col("_nth") <= k + 1)
        .groupBy("x")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("spread", F.pmod(F.xxhash64("x"), F.lit(_HASH_RANGE)))
    )
    groups = durable(groups, "vectors")
    size = groups.count()
    depth = depth_for(size)
    share = min(1.0, (SAMPLE_OF_LEAF << depth) / max(size, 1))
    sample = groups.where(F.col("spread") < int(share * _HASH_RANGE)).select("x").toArrow()
    points = _matrix(sample.column("x").combine_chunks()) if sample.num_rows else np.zeros((0, dimension))
    points = points[np.lexsort(points.T)] if len(points) else points
    forest = fit(points, depth)
    if visits is None:
        visits = calibrated(groups, asked, forest, k)
    trees = spark.sparkContext.broadcast(forest)
    counted = groups.select("x").mapInArrow(_cell_rows(trees), "cell long").groupBy("cell").count()
    # One entry for each leaf: bounded by the sample.
    counts: list[dict[int, int]] = [{} for _ in range(TREES)]
    sizes: dict[int, int] = {}
    for r in counted.collect():
        tree, leaf = divmod(r.cell, _CELLS)
        counts[tree][leaf] = r["count"]
        node = tree * _CELLS + (leaf >> _group_shift(forest))
        sizes[node] = sizes.get(node, 0) + r["count"]
    blocks = {node: -(-n // BLOCK_VECTORS) for node, n in sizes.items()}
    entry = spark.sparkContext.broadcast((forest, blocks))
    plan = spark.sparkContext.broadcast((forest, counts, blocks, visits, k + 1))
    entries = groups.select("ids", "x", "spread").mapInArrow(_entry_rows(entry), _CELL)
    return (
        entries.unionByName(asked.mapInArrow(_visit_rows(plan), _CELL))
        .repartition(tasks, "cell", "block")
        .sortWithinPartitions("cell", "block", "kind")
        .mapInArrow(_ranked_rows(k), "query_id long, ids binary, scores binary")
        .repartition(tasks, "query_id")
        .sortWithinPartitions("query_id")
        .mapInArrow(_merged_rows(k), "query_id long, rank int, vec_id long, score double")
    )
