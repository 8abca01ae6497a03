"""Roles of transcript lines by a hidden Markov model, and canonical turns.

States are (role, begins a turn) pairs. A line shows a speaker marker (of
several common styles, or none), its length class, whether it is blank, ends
as a question and starts a sentence. Start, transition and emission counts are
taken from labelled lines with Spark aggregates and smoothed. Viterbi gives the
likeliest states of a conversation.

A conversation may be of any length. Lines are range-partitioned in order; a
partition holds parts of conversations. For the parts that reach over an edge,
the best score from each entry state to each exit state is a small max-plus
matrix, and these are combined over the partitions, a few numbers for each.
Each partition then decodes its own lines with the scores at its edges known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import durable

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
# Markers by role, fixed values of common chat formats.
MARKERS = {
    "system": ("system:", "<|system|>", "### system:", "[system]"),
    "user": ("user:", "human:", "<|user|>", "### instruction:", "q:"),
    "assistant": ("assistant:", "ai:", "bot:", "<|assistant|>", "### response:", "a:"),
}
SMOOTHING = 0.5
LENGTHS = (40, 160, 640)


def marker_of(line: Column) -> Column:
    """Role whose marker the line begins with, or `none`."""
    start = F.lower(F.ltrim(line))
    found = F.lit("none")
    for role, marks in MARKERS.items():
        begins = F.lit(False)
        for mark in marks:
            begins = begins | start.startswith(mark)
        found = F.when(begins, role).otherwise(found)
    return found


def without_marker(line: Column) -> Column:
    """The line behind its speaker marker."""
    marks = "|".join(sorted((m.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for ms in MARKERS.values() for m in ms), key=len, reverse=True))
    return F.regexp_replace(line, rf"(?i)^\s*(?:{marks})[ \t]*", "")


def observation(line: Column) -> Column:
    """What the model sees of a line, as a short text."""
    text = F.coalesce(without_marker(line), F.lit(""))
    size = F.length(text)
    length = F.lit(len(LENGTHS))
    for number, limit in reversed(list(enumerate(LENGTHS))):
        length = F.when(size <= limit, number).otherwise(length)
    return F.concat_ws(
        "/",
        marker_of(F.coalesce(line, F.lit(""))),
        F.when(F.trim(text) == "", "blank").otherwise(length.cast("string")),
        F.when(F.rtrim(text).endswith("?"), "question").otherwise("plain"),
        F.when(text.rlike(r"^\s*\p{Lu}"), "opens").otherwise("runs"),
    )


def state_of(role: Column, begins: Column) -> Column:
    number = F.lit(None).cast("int")
    for at, (name, first) in enumerate(STATES):
        number = F.when((role == name) & (begins == first), at).otherwise(number)
    return number


def fit(labelled: DataFrame) -> dict[str, object]:
    """Model from `state`, `previous` (state of the line before, null at a start) and `seen`.

    The driver gets counts by state and by state and observation only.
    """
    size = len(STATES)
    start, move = np.full(size, SMOOTHING), np.full((size, size), SMOOTHING)
    for row in labelled.where("state IS NOT NULL").groupBy("previous", "state").count().collect():
        if row.previous is None:
            start[row.state] += row["count"]
        else:
            move[row.previous, row.state] += row["count"]
    # A turn goes on in its own role only.
    for a, (role, _) in enumerate(STATES):
        for b, (other, begins) in enumerate(STATES):
            if not begins and role != other:
                move[a, b] = 0
    for b, (_, begins) in enumerate(STATES):
        if not begins:
            start[b] = 0
    rows = labelled.where("state IS NOT NULL").groupBy("state", "seen").count().collect()
    kinds = sorted({r.seen for r in rows})
    show = np.full((size, len(kinds) + 1), SMOOTHING)
    for row in rows:
        show[row.state, kinds.index(row.seen)] += row["count"]
    with np.errstate(divide="ignore"):
        return {
            "start": np.log(start / start.sum()),
            "move": np.log(move / move.sum(axis=1, keepdims=True)),
            "show": np.log(show / show.sum(axis=1, keepdims=True)),
            "kinds": {kind: at for at, kind in enumerate(kinds)},
        }


def _shown(model: dict, seen: list[str]) -> np.ndarray:
    """Emission scores of each line; an observation never met in training counts as the spare one."""
    spare = len(model["kinds"])
    return model["show"][:, [model["kinds"].get(kind, spare) for kind in seen]].T


def passage(model: dict, shown: np.ndarray, fresh: bool) -> np.ndarray:
    """Best score from each state before the lines (or from their start) to each state at their end."""
    size = len(STATES)
    if fresh:
        best = np.tile(model["start"] + shown[0], (size, 1))
        rest = shown[1:]
    else:
        best = model["move"] + shown[0]
        rest = shown[1:]
    for line in rest:
        best = (best[:, :, None] + model["move"][None]).max(axis=1) + line
    return best


def decoded(model: dict, shown: np.ndarray, entry: np.ndarray | None, after: np.ndarray | None) -> list[int]:
    """Likeliest states of the lines. `entry`: scores before them; `after`: what follows is worth from each end."""
    best = model["start"] + shown[0] if entry is None else (entry[:, None] + model["move"]).max(axis=0) + shown[0]
    back = np.zeros((len(shown), len(STATES)), np.int8)
    for at in range(1, len(shown)):
        ways = best[:, None] + model["move"]
        back[at] = ways.argmax(axis=0)
        best = ways.max(axis=0) + shown[at]
    state = int((best if after is None else best + after).argmax())
    states = [state]
    for at in range(len(shown) - 1, 0, -1):
        state = int(back[at, state])
        states.append(state)
    return states[::-1]


_EDGE = "range int, conv binary, first boolean, last boolean, scores binary"


def _segments(batches: Iterator[pa.RecordBatch]):
    """Consecutive rows of one conversation: its name, observations and rows."""
    current, seen, rows = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["_conv"] != current:
                if rows:
                    yield current, seen, rows
                current, seen, rows = row["_conv"], [], []
            seen.append(row["seen"])
            rows.append(row)
    if rows:
        yield current, seen, rows


def _edge_rows(shared):
    """First and last part of each range with its max-plus matrices, fresh and carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held = None
        out = []

        def matrices(seen):
            shown = _shown(model, seen)
            return np.stack([passage(model, shown, True), passage(model, shown, False)]).tobytes()

        number = None
        for conv, seen, rows in _segments(batches):
            if number is None:
                number = rows[0]["_range"]
                out.append([number, conv, True, False, matrices(seen)])
            held = (conv, seen)
        if number is not None:
            if held[0] == out[0][1]:
                out[0][3] = True
            else:
                out.append([number, held[0], False, True, matrices(held[1])])
            columns = zip(*out, strict=True)
            kinds = (pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["range", "conv", "first", "last", "scores"],
            )

    return run


def edge_scores(model: dict, edges: list) -> tuple[dict, dict]:
    """Scores before the first part and worth after the last part of each range, where a conversation goes on."""
    size = len(STATES)
    parts = []
    for e in sorted(edges, key=lambda e: (e["range"], not e["first"])):
        both = np.frombuffer(e["scores"], np.float64).reshape(2, size, size)
        parts.append((e["range"], e["conv"], e["first"], e["last"], both))
    before, after = {}, {}
    carried = None
    for at, (number, conv, first, last, both) in enumerate(parts):
        goes_on = bool(at) and first and parts[at - 1][3] and parts[at - 1][1] == conv
        if goes_on:
            before[number] = carried
            scores = (carried[:, None] + both[1]).max(axis=0)
        else:
            scores = both[0].max(axis=0)
        carried = scores if last else None
    worth = None
    for at in range(len(parts) - 1, -1, -1):
        number, conv, first, last, both = parts[at]
        goes_on = at + 1 < len(parts) and last and parts[at + 1][2] and parts[at + 1][1] == conv
        if goes_on:
            after[number] = worth
        reached = both[1] + (after[number] if goes_on else 0.0)
        worth = reached.max(axis=1) if first else None
    return before, after


def _state_rows(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, before, after, schema = shared.value
        pending = None
        first = True

        def answered(part, entry, worth):
            _, seen, rows = part
            states = decoded(model, _shown(model, seen), entry, worth)
            data = {c: [r[c] for r in rows] for c in columns}
            data["state"] = states
            return pa.RecordBatch.from_arrays(
                [pa.array(data[field.name], field.type) for field in schema], schema=schema
            )

        number = None
        for part in _segments(batches):
            number = part[2][0]["_range"]
            if pending is not None:
                yield answered(pending, before.get(number) if first else None, None)
                first = False
            pending = part
        if pending is not None:
            yield answered(pending, before.get(number) if first else None, after.get(number))

    return run


def parse(lines: DataFrame, model: dict) -> DataFrame:
    """Roles of lines and their canonical form.

    Takes `conv_id`, `turn`, `line_no` and `line`, in which turn and line number
    give the order (nulls first, then ties by the line itself); returns
    `conv_id`, `turn`, `line_no`, `role`, `begins` (whether a turn begins here) and
    `rendered`: the line without its speaker marker, after a `<|role|>` line where
    a turn begins. A null line is an empty one; lines of a null conv_id are one
    conversation; repeated rows are lines of their own. Joined by line ends,
    the rendered lines of a conversation are its canonical transcript.
    """
    spark = lines.sparkSession
    conv_type = lines.schema["conv_id"].dataType.simpleString()
    keyed = lines.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("line_no").cast("long").alias("line_no"),
        F.coalesce("line", F.lit("")).alias("line"),
    ).select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary").alias("_conv"), F.col("conv_id").isNull().alias("_none"), observation(F.col("line")).alias("seen"))
    keyed = keyed.withColumn("_conv", F.concat(F.when(F.col("_none"), F.lit("n")).otherwise(F.lit("c")).cast("binary"), F.col("_conv"))).drop("_none")
    order = ["_conv", "turn", "line_no", "line"]
    ranged = durable(keyed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "lines")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranged.repartitionById(tasks, "_range").sortWithinPartitions("_range", *order)
    known = spark.sparkContext.broadcast(model)
    # Two rows for each range partition at most.
    edges = dealt.select("_range", "_conv", "seen").mapInArrow(_edge_rows(known), _EDGE).collect()
    before, after = edge_scores(model, edges)
    columns = ["conv_id", "turn", "line_no", "line"]
    kept = dealt.select(*columns, "_conv", "_range", "seen")
    schema = pa.schema(
        [(f.name, f.type) for f in spark.createDataFrame([], kept.select(*columns).schema).toArrow().schema] + [("state", pa.int32())]
    )
    shared = spark.sparkContext.broadcast((model, before, after, schema))
    states = kept.mapInArrow(
        _state_rows(shared, columns), f"conv_id {conv_type}, turn long, line_no long, line string, state int"
    )
    role = F.element_at(F.array(*[F.lit(name) for name, _ in STATES]), F.col("state") + 1)
    begins = F.element_at(F.array(*[F.lit(first) for _, first in STATES]), F.col("state") + 1)
    return states.select(
        "conv_id",
        "turn",
        "line_no",
        role.alias("role"),
        begins.alias("begins"),
        F.when(begins, F.concat(F.lit("<|"), role, F.lit("|>\n"), without_marker(F.col("line"))))
        .otherwise(F.col("line"))
        .alias("rendered"),
    )
