"""Training of token vectors.

Skip-gram with negative sampling. Windows are counted once: a pair of words weighs as
much as skip-gram's random windows would give it on average, and each epoch goes over all
pairs twice: contexts move while centers are fixed, then centers while contexts are
fixed. Vectors lie in parts; a task moves one part and reads the others one after
another (see `grid`), so that vectors are neither copied nor shuffled. Neither the driver
nor a task holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import frames, grid, profile
from lexloom.operators.store import of_language
from lexloom.session import drop, durable

# Wrong contexts per pair, contexts drawn for a step at least, pairs for each that is moved, step, power of the
# frequency by which they are drawn.
NEGATIVES = 5
DRAWN = 32
DRAW_PAIRS = 128
RATE = 0.1
NOISE_POWER = 0.75
# Words of a part in a row; pairs that move the vectors at once; pairs of a word met side by side with others.
ROW_WORDS = 1024
STEP_PAIRS = 8192
SHORT_RUN = 64
UNBOUNDED = 2**31 - 1
_TINY = np.float32(1e-12)

# Columns of a part: the vector, its sum of squared steps, its weight as a wrong context.
_EXTRA = 2
_STATE = "part int, seq int, data binary"


class Trained(NamedTuple):
    vectors: DataFrame  # token, vec


def _fields(schema: str) -> pa.Schema:
    types = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, types[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _started(size: int, seed: int, kind: int):
    """First vectors of rows (part, seq, freqs): small random centers, contexts of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = np.zeros((len(row["freqs"]), size + _EXTRA), np.float32)
                if kind == grid.CENTERS:
                    drawn = np.random.default_rng([seed % 2**63, row["part"], row["seq"]])
                    table[:, :size] = (drawn.random((len(table), size)) - 0.5) / size
                else:
                    table[:, -1] = np.array(row["freqs"], float) ** NOISE_POWER
                yield grid.record([(row["part"], row["seq"], grid.binary(table))], _fields(_STATE))

    return run


def _move(table: np.ndarray, places: np.ndarray, gradient: np.ndarray) -> None:
    """A step along the gradient whose length falls with the steps that a word has made (Adagrad by row)."""
    size = gradient.shape[1]
    squares = table[places, size] + np.einsum("ij,ij->i", gradient, gradient) / size
    table[places, size] = squares
    table[places, :size] += gradient * (RATE / np.sqrt(squares + _TINY))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, as new arrays of this size cost more than the function."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _pulls(vectors: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fixed: np.ndarray, theirs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each vector the gradient of the likelihood of its pairs, a run of `theirs`."""
    up = np.empty_like(vectors)
    wide = 1 << np.ceil(np.log2(sizes)).astype(int)
    for width in np.unique(wide[sizes <= SHORT_RUN]).tolist():
        some = np.flatnonzero(wide == width)
        places = np.minimum(np.arange(width), sizes[some, None] - 1) + starts[some, None]
        near = np.take(fixed, theirs[places], axis=0)
        strength = np.where(np.arange(width) < sizes[some, None], weight[places], 0)
        strength *= _sigmoid(-np.einsum("nwd,nd->nw", near, vectors[some]))
        up[some] = np.einsum("nw,nwd->nd", strength, near)
    for n in np.flatnonzero(sizes > SHORT_RUN).tolist():
        run = slice(starts[n], starts[n] + sizes[n])
        near = np.take(fixed, theirs[run], axis=0)
        up[n] = (weight[run] * _sigmoid(-(near @ vectors[n]))) @ near
    return up


def _step(kind: int, table: np.ndarray, fixed: np.ndarray, pairs: tuple, noise: np.ndarray, drawn: np.random.Generator) -> None:
    """Raise the likelihood of pairs, sorted by the words that move, and lower that of the centers with wrong contexts."""
    ours, theirs, weight = pairs
    size = fixed.shape[1]
    starts = np.flatnonzero(np.diff(ours, prepend=-1))
    words, vectors = ours[starts], table[ours[starts], :size]
    up = _pulls(vectors, starts, np.diff(starts, append=len(ours)), fixed, theirs, weight)
    many = DRAWN if kind == grid.CENTERS else max(DRAWN, len(ours) // DRAW_PAIRS)
    wrong = np.minimum(np.searchsorted(noise, drawn.random(many) * noise[-1], side="right"), len(noise) - 1)
    share = np.float32(-NEGATIVES / many)
    if kind == grid.CENTERS:
        others = fixed[wrong]
        push = _sigmoid(vectors @ others.T) * (np.add.reduceat(weight, starts) * share)[:, None]
        _move(table, words, up + push @ others)
        return
    centers, times = np.unique(theirs, return_inverse=True)
    others = fixed[centers]
    total = np.bincount(times, weight).astype(np.float32)
    push = _sigmoid(others @ table[wrong, :size].T) * (total * share)[:, None]
    places = np.union1d(words, wrong)
    gradient = np.zeros((len(places), size), np.float32)
    gradient[np.searchsorted(places, words)] = up
    np.add.at(gradient, np.searchsorted(places, wrong), push.T @ others)
    _move(table, places, gradient)


def _passed(side: int, size: int, seed: int, epoch: int, kind: int):
    """Move the vectors of a part on all its pairs, while those of the other kind are fixed."""

    def stored(files: list[str]) -> np.ndarray:
        return np.concatenate([np.frombuffer(data, np.float32) for data, in grid.stored_rows(files, "data")]).reshape(-1, size + _EXTRA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for i, j, own, other, pairs in grid.blocks_met(batches, side):
            if table is None:
                table, drawn = stored(own), np.random.default_rng([seed % 2**63, epoch, kind, i])
            if not pairs:
                continue
            fixed = stored(other)
            noise = np.cumsum((fixed if kind == grid.CENTERS else table)[:, -1], dtype=float)
            fixed = np.ascontiguousarray(fixed[:, :size])
            for ours, theirs, weight in grid.pairs_met(i, j, pairs, np.float32):
                chunk = ours // side, theirs // side, weight
                for low in range(0, len(ours), STEP_PAIRS):
                    _step(kind, table, fixed, tuple(column[low : low + STEP_PAIRS] for column in chunk), noise, drawn)
        if table is not None:
            for seq, low in enumerate(range(0, len(table), ROW_WORDS)):
                yield grid.record([(i, seq, grid.binary(table[low : low + ROW_WORDS]))], _fields(_STATE))

    return run


def _unpacked(side: int, size: int):
    """(word, vec) of the rows of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, seqs, data = batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("data")
            for n, (part, seq) in enumerate(zip(parts, seqs)):
                table = np.frombuffer(data[n].as_buffer(), np.float32).reshape(-1, size + _EXTRA)[:, :size]
                words = part + side * (seq * ROW_WORDS + np.arange(len(table)))
                ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * size)
                vectors = pa.ListArray.from_arrays(ends, pa.array(table.astype(float).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), vectors], names=["word", "vec"])

    return run


def train_vectors(
    tokenised: DataFrame,
    size: int = 200,
    window: int = 5,
    min_count: int = 10,
    epochs: int = 5,
    seed: int = 42,
    partitions: int | None = None,
    max_sentence: int = UNBOUNDED,
) -> Trained:
    """Skip-gram vectors of a tokenised corpus (doc_id, language, tokens).

    At least `partitions` parts of the vectors train in parallel; one per core unless
    given. Reruns with the same number agree. Every
    token that occurs `min_count` times has a vector; rarer ones are left out before
    windows are taken, and lists are cut after `max_sentence` of the others.
    """
    spark = tokenised.sparkSession
    corpus = tokenised.where(F.col("tokens").isNotNull())
    # Null within a list is a token, as it is to MLlib.
    rows = corpus.select(F.posexplode_outer("tokens").alias("pos", "token")).where("pos IS NOT NULL")
    frequent = durable(profile.frequent_tokens(rows, min_count), "frequent")
    index, lists = frames.numbered_lists(corpus, frequent)
    if max_sentence < UNBOUNDED:
        starts = F.sequence(F.lit(1), F.size("tokens"), F.lit(max_sentence))
        cut = F.transform(starts, lambda start: F.slice("tokens", start, F.lit(max_sentence)))
        lists = lists.where(F.size("tokens") > 0).select(F.explode(cut).alias("tokens"))
    words, width = index.count(), size + _EXTRA
    tasks = spark.sparkContext.defaultParallelism if partitions is None else partitions
    side = grid.parts_of(words, 4 * width, tasks)
    blocks = grid.blocks_of(frames.near_pairs(lists, window), side, np.float32)
    place = F.floor(F.col("word") / side)
    numbered = index.join(frequent.withColumnRenamed("token", "_token"), F.col("token").eqNullSafe(F.col("_token"))).select(
        "word", "freq", (F.col("word") % side).alias("part"), F.floor(place / ROW_WORDS).cast("int").alias("seq")
    )
    rows = numbered.groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("word", "freq"))).alias("words"))
    rows = rows.select("part", "seq", F.col("words.freq").alias("freqs"))
    tables = [
        grid.stored_parts(rows.mapInArrow(_started(size, seed, kind), _STATE), side, "seq")
        for kind in (grid.CENTERS, grid.CONTEXTS)
    ]
    for epoch in range(epochs):
        for kind in (grid.CONTEXTS, grid.CENTERS):
            met = grid.plan(side, tables[kind], tables[1 - kind], blocks)
            moved = durable(grid.meet(met, side, _passed(side, size, seed, epoch, kind), _STATE), "parts", by="part")
            drop(tables[kind])
            tables[kind] = moved
    drop(blocks)
    drop(tables[grid.CONTEXTS])
    vectors = tables[grid.CENTERS].mapInArrow(_unpacked(side, size), "word int, vec array<double>")
    return Trained(index.join(vectors, "word").select("token", "vec"))


def train_language_vectors(tokenised: DataFrame, language: str, **options) -> Trained:
    return train_vectors(of_language(tokenised, language), **options)


def vectors_of(model: Trained) -> DataFrame:
    return model.vectors
