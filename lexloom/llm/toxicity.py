"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the words of a text (runs of letters, lower-cased), its word pairs
and its skip-grams (pairs with one or two words between), hashed into
`2 ** BITS` columns; a feature is there or not. Learning takes one document at
a time with a rate for each coordinate; the L1 term leaves few weights, which
are broadcast to score all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import grams
from lexloom.llm.training import held_out, labelled_sample

BITS = 20
SAMPLE_ROWS = 12_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.01
THRESHOLD = 0.7

_BREAKS = np.ones(256, bool)
_BREAKS[ord("a") : ord("z") + 1] = False
_BREAKS[0x80:] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and text number of every feature met, repeats included."""
    _, _, words, owner = grams.words_of(grams.lowered(data), offsets, _BREAKS)
    columns, texts = [words], [owner]
    for gap in (1, 2, 3):
        pairs = grams.mixed(words[:-gap] * np.uint64(2 * gap + 1) + grams.mixed(words[gap:] + np.uint64(gap)))
        inside = owner[:-gap] == owner[gap:]
        columns.append(pairs[inside])
        texts.append(owner[:-gap][inside])
    mask = np.uint64(2**BITS - 1)
    return np.concatenate([c & mask for c in columns]).astype(np.int32), np.concatenate(texts)


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in grams.text_blocks(batch, "text"):
            column, text = features(*grams.buffer_of(block.column("text")))
            both = np.unique(text.astype(np.int64) << BITS | column)
            counts = np.bincount(both >> BITS, minlength=block.num_rows)
            packed = grams.binary_rows((both & (2**BITS - 1)).astype(np.int32), counts)
            yield pa.RecordBatch.from_arrays([block.column("order"), packed, block.column("y")], names=["order", "columns", "y"])


def fit(examples: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Weights of all columns and, last, the bias."""
    size = 2**BITS + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        active = z[at]
        shrunk = np.sign(active) * np.maximum(np.abs(active) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for columns, y in zip(examples, labels, strict=True):
            at = np.append(columns, size - 1)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = np.sqrt(n[at] + gradient * gradient)
            z[at] += gradient - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += gradient * gradient
    return weights(np.arange(size))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("order", "columns", "y")), strict=True)
    rows.sort(key=lambda row: (row[0], row[1]))
    found = fit([np.frombuffer(columns, np.int32) for _, columns, _ in rows], [y for _, _, y in rows])
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["column", "weight"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the weights that are not zero.

    Learning is sequential, so one task takes the sample, which `SAMPLE_ROWS` bounds.
    """
    examples = labelled_sample(docs, labels, "toxic", SAMPLE_ROWS).mapInArrow(
        _example_rows, "order long, columns binary, y int"
    )
    rows = examples.repartition(1).mapInArrow(_fit_rows, "column long, weight double").collect()
    return np.array([r.column for r in rows], np.int64), np.array([r.weight for r in rows])


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        weights = np.zeros(2**BITS + 1)
        weights[at] = values
        used = weights != 0
        for batch in batches:
            scores = []
            for block in grams.text_blocks(batch, "text"):
                column, text = features(*grams.buffer_of(block.column("text")))
                kept = used[column]
                both = np.unique(text[kept].astype(np.int64) << BITS | column[kept])
                sums = np.bincount(both >> BITS, weights=weights[both & (2**BITS - 1)], minlength=block.num_rows)
                scores.append(1 / (1 + np.exp(-np.clip(sums + weights[-1], -35, 35))))
            kept = batch.drop_columns(["text"])
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score)], names=[*kept.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` for every row of `docs`.

    Needs `doc_id` and `text` there and `doc_id` and `toxic` in `labels`; other
    columns are not used. A null or empty text has no features and scores by
    the bias alone. A null doc_id is scored like any other and not held out.
    Repeated rows are scored alike. Without usable labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", held_out().alias("held_out"), "text")
        .mapInArrow(_score_rows(shared), f"doc_id {kind}, held_out boolean, score double")
        .withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    )
