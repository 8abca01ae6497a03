"""Quality by a convolutional network over bytes, written in numpy.

A text is covered by overlapping chunks of bytes. In each chunk the bytes are
looked up in a learned table, filters slide over them, and each filter keeps
its largest response. A chunk's responses give one number; the mean of these
over all chunks of the text is the logit of its quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import grams
from lexloom.llm.training import held_out, labelled_sample

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 8, 1
TABLE, FILTERS = 4, 24
SAMPLE_ROWS = 6_000
EPOCHS = 4
TEXTS_PER_STEP = 32
RATE = 0.01
CHUNKS_AT_ONCE = 512
THRESHOLD = 0.5
PADDING = 256

Model = dict[str, np.ndarray]


def fresh_model(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    return {
        "table": rng.normal(0, 0.5, (257, TABLE)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * TABLE) ** -0.5, (WIDTH * TABLE, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }


def chunk_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk and its text number; an empty text has one empty chunk."""
    sizes = np.diff(offsets)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + nth * step
    return start, np.minimum(start + CHUNK, offsets[text + 1]), text


def chunk_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    if not len(data):
        return np.full(at.shape, PADDING, np.int16)
    # PADDING is beyond the range of a byte.
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(PADDING))


def responses(model: Model, units: np.ndarray):
    """Largest response of each filter in each chunk and where it is."""
    looked = model["table"][units]
    views = np.lib.stride_tricks.sliding_window_view(looked, WIDTH, axis=1)[:, ::STRIDE]
    windows = np.ascontiguousarray(views.transpose(0, 1, 3, 2)).reshape(len(units), -1, WIDTH * TABLE)
    found = windows @ model["filters"]
    where = found.argmax(axis=1)
    best = np.take_along_axis(found, where[:, None, :], axis=1)[:, 0] + model["shift"]
    return windows, where, best


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logit of each text, all of its chunks considered."""
    start, end, text = chunk_starts(offsets)
    sums = np.zeros(len(offsets) - 1)
    for low in range(0, len(start), CHUNKS_AT_ONCE):
        part = slice(low, low + CHUNKS_AT_ONCE)
        units = chunk_bytes(data, start[part], end[part])
        _, _, best = responses(model, units)
        values = np.maximum(best, 0) @ model["out"] + model["bias"][0]
        sums += np.bincount(text[part], weights=values, minlength=len(sums))
    return sums / np.bincount(text, minlength=len(sums))


def _gradients(model: Model, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> Model:
    start, end, text = chunk_starts(offsets)
    counts = np.bincount(text)
    total = {name: np.zeros_like(value) for name, value in model.items()}
    slope = (1 / (1 + np.exp(-np.clip(logits(model, data, offsets), -35, 35))) - y) / len(y) / counts
    for low in range(0, len(start), CHUNKS_AT_ONCE):
        part = slice(low, low + CHUNKS_AT_ONCE)
        units = chunk_bytes(data, start[part], end[part])
        windows, where, best = responses(model, units)
        up = slope[text[part]].astype(np.float32)
        live = np.maximum(best, 0)
        total["out"] += up @ live
        total["bias"] += up.sum()
        back = np.where(best > 0, up[:, None] * model["out"], 0).astype(np.float32)
        total["shift"] += back.sum(axis=0)
        chosen = windows[np.arange(len(units))[:, None], where]
        total["filters"] += np.einsum("cf,cfw->wf", back, chosen)
        spread = back[:, :, None] * model["filters"].T
        places = where[:, :, None] * STRIDE + np.arange(WIDTH)
        bytes_met = units[np.arange(len(units))[:, None, None], places]
        for column in range(TABLE):
            total["table"][:, column] += np.bincount(
                bytes_met.ravel(), weights=spread[:, :, column::TABLE].ravel(), minlength=257
            )
    return total


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Adam over whole texts, in the order given."""
    model = fresh_model()
    if not texts:
        model["out"][:] = 0
        return model
    mean, square = ({name: np.zeros_like(v) for name, v in model.items()} for _ in range(2))
    rate = np.clip(np.mean(labels), 0.01, 0.99)
    model["bias"][0] = np.log(rate / (1 - rate))
    step = 0
    steps = EPOCHS * -(-len(texts) // TEXTS_PER_STEP)
    for _ in range(EPOCHS):
        for low in range(0, len(texts), TEXTS_PER_STEP):
            part = texts[low : low + TEXTS_PER_STEP]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
            found = _gradients(
                model, np.frombuffer(b"".join(part), np.uint8), offsets, np.array(labels[low : low + TEXTS_PER_STEP])
            )
            step += 1
            pace = RATE * (1 - 0.9 * step / steps)
            for name, value in found.items():
                mean[name] = 0.9 * mean[name] + 0.1 * value
                square[name] = 0.999 * square[name] + 0.001 * value**2
                move = mean[name] / (1 - 0.9**step) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
                model[name] -= (pace * move).astype(np.float32)
    return model


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(*(batch.column(c).to_pylist() for c in ("order", "text", "y")), strict=True)
    rows.sort()
    model = fit([text.encode() for _, text, _ in rows], [y for _, _, y in rows])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(model)),
            pa.array([v.astype(np.float64).ravel().tolist() for v in model.values()]),
        ],
        names=["name", "values"],
    )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The fitted network.

    Learning is sequential, so one task takes the sample, which `SAMPLE_ROWS` bounds.
    """
    sample = labelled_sample(docs, labels, "quality", SAMPLE_ROWS)
    rows = sample.repartition(1).mapInArrow(_fit_rows, "name string, values array<double>").collect()
    shapes = {name: value.shape for name, value in fresh_model().items()}
    if not rows:
        return fit([], [])
    return {r.name: np.array(r["values"], np.float32).reshape(shapes[r.name]) for r in rows}


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [np.zeros(0)]
            for block in grams.text_blocks(batch, "text"):
                found.append(logits(model, *grams.buffer_of(block.column("text"))))
            scores = 1 / (1 + np.exp(-np.clip(np.concatenate(found), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of `docs` with `score`, the probability of good quality.

    Needs `doc_id` and `text` there, and `doc_id` and `quality` in `labels`;
    only `text` is an input of the score. A null or empty text is one empty
    chunk and is scored as such. A column named `score` is replaced. Repeated
    rows are scored alike. Without usable labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(_score_rows(shared), schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` for every row."""
    return score(docs.select("doc_id", "text"), labels).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
