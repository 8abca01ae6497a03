"""Dense vectors of a counted table by randomised subspace iteration.

The table is sparse and symmetric: (center, context, weight). A thin basis, one row of
few numbers per word, is multiplied with it block by block (see `grid`): a task sums one
part of the product and reads the parts of the basis and the pairs one after
another. Pairs are stored once, one way, and not shuffled again. The basis is made
orthonormal again from its Gram matrix, which has one row per column of the basis.
Only such small matrices reach the driver; table, basis and vectors stay tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import grid
from lexloom.session import drop, durable

EXTRA = 10
ROUNDS = 8
TOLERANCE = 1e-3
# Words of a part in a row; pairs multiplied at once.
ROW_WORDS = 1024
STEP_PAIRS = 16_384
# Directions with less of the largest one than this are rounding errors.
_LEAST = 1e-12
_PARTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("words", pa.binary()), ("data", pa.binary())])


class Dense(NamedTuple):
    vectors: DataFrame  # word, vec
    values: list[float]  # eigenvalues of the table, largest sizes first
    residuals: list[float]  # length of (table * vector - value * vector) of unit vectors


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _grams(rows: DataFrame, *pairs: tuple[str, str]) -> list[np.ndarray]:
    """For each pair of array columns a, b the sum over all rows of a' b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                part = np.stack([_matrix(batch.column(a)).T @ _matrix(batch.column(b)) for a, b in pairs])
                sums = part if sums is None else sums + part
        if sums is not None:
            which, i, j = (axis.ravel() for axis in np.indices(sums.shape))
            yield pa.RecordBatch.from_pydict({"which": which, "i": i, "j": j, "v": sums.ravel()})

    needed = list(dict.fromkeys(name for pair in pairs for name in pair))
    entries = rows.select(*needed).mapInArrow(run, "which long, i long, j long, v double")
    found = entries.groupBy("which", "i", "j").agg(F.sum("v").alias("v")).collect()
    wide = max((row["i"] for row in found), default=-1) + 1
    grams = np.zeros((len(pairs), wide, wide))
    for row in found:
        grams[row["which"], row["i"], row["j"]] = row["v"]
    return list(grams)


def _turned(rows: DataFrame, column: str, turn: np.ndarray, name: str) -> DataFrame:
    """(word, `name`): each row of `column` times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(column)) @ turn if batch.num_rows else np.zeros((0, turn.shape[1]))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists], names=["word", name])

    return rows.select("word", column).mapInArrow(run, f"word int, {name} array<double>")


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """Matrix that turns columns with this Gram matrix into orthonormal ones that span the same."""
    values, vectors = np.linalg.eigh(gram)
    kept = values > _LEAST * max(values.max(initial=0.0), 0.0)
    return vectors[:, kept] / np.sqrt(values[kept])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of blocks of pairs."""
    for batch in batches:
        for row in zip(batch.column("a"), batch.column("b")):
            words = np.unique(np.concatenate([np.frombuffer(numbers.as_buffer(), np.int32) for numbers in row]))
            yield pa.RecordBatch.from_arrays([pa.array(words)], names=["word"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, word, row) of a part, which come together, as (part, seq, words, data)."""
    for batch in batches:
        parts, words = batch.column("part").to_numpy(), batch.column("word").to_numpy()
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for low, high in zip(starts, np.append(starts[1:], len(parts))):
            rows = _matrix(batch.column("row").slice(low, high - low))
            yield grid.record([(parts[low], words[low], grid.binary(words[low:high]), grid.binary(rows))], _PARTS)


def _parts(basis: DataFrame, side: int) -> DataFrame:
    """Rows (word, row) stored in parts, as a basis is if it has been stored before."""
    if "data" in basis.columns:
        return basis
    rows = basis.select((F.col("word") % side).alias("part"), "word", "row")
    dealt = rows.repartitionById(side, F.col("part")).sortWithinPartitions("part", "word")
    return durable(dealt.mapInArrow(_packed, "part int, seq int, words binary, data binary"), "basis", by="part")


def _places(words: np.ndarray, sorted_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among the sorted ones, and where."""
    places = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    known = np.flatnonzero(sorted_words[places] == words)
    return known, places[known]


def _multiplied(side: int, wide: int):
    """Of a part its words, its rows of the basis, and the product of its pairs and the basis."""

    def stored(files: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, rows = zip(*grid.stored_rows(files, "words", "data"))
        return np.concatenate([np.frombuffer(some, np.int32) for some in words]), np.concatenate([np.frombuffer(some) for some in rows]).reshape(-1, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = None
        for i, j, own, other, pairs in grid.blocks_met(batches, side):
            if image is None:
                words, rows = stored(own)
                image = np.zeros(rows.shape)
            if not pairs or not other:
                continue
            contexts, basis = stored(other)
            for center, context, weight in grid.pairs_met(i, j, pairs, np.float64):
                for low in range(0, len(center), STEP_PAIRS):
                    high = low + STEP_PAIRS
                    known, places = _places(context[low:high], contexts)
                    found, sums = grid.sums(basis[places] * weight[low:high][known, None], center[low:high][known])
                    ours, places = _places(found, words)
                    image[places] += sums[ours]
        if image is not None:
            for low in range(0, len(words), ROW_WORDS):
                high = min(low + ROW_WORDS, len(words))
                ends = pa.array(np.arange(high - low + 1, dtype=np.int32) * wide)
                lists = [pa.ListArray.from_arrays(ends, pa.array(table[low:high].ravel())) for table in (rows, image)]
                yield pa.RecordBatch.from_arrays([pa.array(words[low:high]), *lists], names=["word", "row", "image"])

    return run


def _times(blocks: DataFrame, basis: DataFrame, side: int, wide: int) -> DataFrame:
    """(word, row, image): the basis, and the table, as blocks of pairs, times the basis."""
    parts = _parts(basis, side)
    met = grid.plan(side, parts, parts, grid.stored_blocks(blocks, side, np.float64))
    return grid.meet(met, side, _multiplied(side, wide), "word int, row array<double>, image array<double>")


def dense_vectors(
    table: DataFrame,
    size: int,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    power: float = 0.5,
    words: int | None = None,
) -> Dense:
    """The `size` leading eigenvectors of a stored symmetric table as vectors of its words.

    A component is scaled by the size of its eigenvalue to `power`: 0.5 gives
    vectors whose products approximate the table. Iterates until no residual
    exceeds `tolerance` of the largest eigenvalue, `rounds` times at most. A table
    of lower rank gives shorter vectors, an empty one none. Words without an entry
    above zero have no vector. `words` is about how many words there are, counted if not given.
    """
    entries = table.where("weight <> 0 AND center IS NOT NULL AND context IS NOT NULL")
    entries = entries.select(F.col("center").cast("int"), F.col("context").cast("int"), F.col("weight").cast("double"))
    if words is None:
        words = entries.select(F.approx_count_distinct("center")).first()[0]
    tasks = table.sparkSession.sparkContext.defaultParallelism
    side = grid.parts_of(words, 8 * (size + EXTRA), tasks)
    blocks = grid.blocks_of(entries, side, np.float64)
    centers = blocks.select("a", "b").mapInArrow(_words_of, "word int").distinct()
    # The hash of word and column as a number from -1 to 1, so that reruns agree.
    drawn = [(F.xxhash64("word", F.lit(n)) / float(1 << 63)).alias(f"c{n}") for n in range(size + EXTRA)]
    start = durable(centers.select("word", F.array(*drawn).alias("row")), "start")
    turn = _orthonormal(_grams(start, ("row", "row"))[0])
    if not turn.shape[1]:
        return Dense(start.select("word", F.col("row").alias("vec")).limit(0), [], [])
    last, column = start, "row"
    for number in range(rounds):
        basis = _parts(_turned(last, column, turn, "row"), side)
        drop(last)
        image = durable(_times(blocks, basis, side, turn.shape[1]), "image")
        drop(basis)
        inner, gram = _grams(image, ("row", "image"), ("image", "image"))
        values, ritz = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:size]
        values, ritz = values[order], ritz[:, order]
        residuals = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", ritz, gram, ritz) - values**2, 0))
        if number + 1 == rounds or not len(values) or residuals.max() <= tolerance * abs(values[0]):
            break
        turn = _orthonormal(gram)
        last, column = image, "image"
    drop(blocks)
    kept = np.abs(values) > 1e-9 * np.abs(values).max(initial=0.0)
    scaled = ritz[:, kept] * np.abs(values[kept]) ** power
    vectors = _turned(image, "row", scaled, "vec")
    return Dense(vectors, values[kept].tolist(), residuals[kept].tolist())
