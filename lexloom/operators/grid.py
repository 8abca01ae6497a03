"""Pairs of numbered words in square blocks.

Words belong to `side` parts by their number. A table of pairs is symmetric, so that a
pair is kept one way: block (i, j), i <= j, numbered i * side + j, holds the pairs of
a word of part i and a word of part j. Blocks, and parts of a table of words, are stored in files of
their own. A task makes one part of a table from all blocks of this part; it reads them and
the parts they meet one after another, so that nothing is shuffled and a task holds two
parts of a table of words and a chunk of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import durable, file_system, files_by

# Bytes of a part in a task, pairs in a row of a block, pairs sorted at once.
PART_BYTES = 64 * 1024 * 1024
CHUNK_PAIRS = 32_768
_HELD_PAIRS = 1 << 20
# Rows summed side by side; longer runs of rows are summed one by one.
_FEW_ROWS = 6
# Rows of a stored table that a task reads at once.
_READ_ROWS = 16
# Rows of pairs of a block in the order of `seq`, with arrays as bytes.
MEETING = "block int, kind int, seq long, a binary, b binary, c binary"
# What meets in a block: files of the part that is made, of the part it meets, of the pairs.
_PLAN = "block int, kind int, files array<string>"
CENTERS, CONTEXTS, PAIRS = range(3)


def side_of(words: int, row_bytes: int, tasks: int) -> int:
    """Parts, so that a part is of bounded size and blocks keep all of `tasks` tasks busy."""
    least = max(1, int(np.ceil(np.sqrt(tasks))), -(-words * row_bytes // PART_BYTES))
    return max(range(least, least + 3), key=lambda side: side * side / (-(-side * side // tasks) * tasks))


def parts_of(words: int, row_bytes: int, tasks: int) -> int:
    """Parts of bounded size that keep all of `tasks` tasks busy, a task for each part."""
    return tasks * -(-side_of(words, row_bytes, 1) // tasks)


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_MEETING = pa.schema(
    [("block", pa.int32()), ("kind", pa.int32()), ("seq", pa.int64())] + [(name, pa.binary()) for name in "abc"]
)


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.int64) << 32 | low


def _row(block: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple:
    # A pair is met once, so that its first one names a row and fixes the order of rows.
    return block, PAIRS, int(a[0]) << 32 | int(b[0]), binary(a), binary(b), binary(c)


def pair_blocks(side: int, dtype: type) -> Callable:
    """Rows of MEETING of batches of (center, context, weight) of a symmetric table: in each the pairs of a block, sorted.

    Pairs are held until a block has CHUNK_PAIRS of them on average, or memory asks for less.
    """
    least = min(CHUNK_PAIRS * side * side, _HELD_PAIRS)

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        center, context, weight = (np.concatenate(column) for column in zip(*held))
        order = np.argsort(_packed(center, context))
        block = center[order] % side * side + context[order] % side
        some = np.argsort(block.astype(np.uint16) if side < 256 else block, kind="stable")
        block, order = block[some], order[some]
        center, context, weight = center[order], context[order], weight[order].astype(dtype)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        return record(
            [
                _row(int(block[low]), center[low:high], context[low:high], weight[low:high])
                for low, high in zip(starts, np.append(starts[1:], len(block)))
            ],
            _MEETING,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            center, context, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            here, there = center % side, context % side
            once = np.flatnonzero((here < there) | ((here == there) & (center <= context)))
            held.append((center[once], context[once], weight[once]))
            many += len(once)
            if many >= least:
                yield dealt(held)
                held, many = [], 0
        if many:
            yield dealt(held)

    return run


def _sorted_rows(dtype: type) -> Callable:
    """The rows of a block, which come together, with the pairs of a word side by side in fewer rows."""

    def dealt(block: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, c = (np.concatenate([np.frombuffer(row[k], kind) for row in held]) for k, kind in enumerate((np.int32, np.int32, dtype)))
        order = np.argsort(_packed(a, b))
        a, b, c = a[order], b[order], c[order]
        for low in range(0, len(a), CHUNK_PAIRS):
            high = low + CHUNK_PAIRS
            yield record([_row(block, a[low:high], b[low:high], c[low:high])], _MEETING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, last = [], 0, None
        for batch in batches:
            blocks, columns = batch.column("block").to_pylist(), [batch.column(name) for name in "abc"]
            for n, block in enumerate(blocks):
                if held and (block != last or many >= _HELD_PAIRS):
                    yield from dealt(last, held)
                    held, many = [], 0
                held.append(tuple(column[n].as_py() for column in columns))
                last, many = block, many + len(held[-1][0]) // 4
        if held:
            yield from dealt(last, held)

    return run


def stored_blocks(rows: DataFrame, side: int, dtype: type) -> DataFrame:
    """Rows of `pair_blocks` in files of each block, as such a table is if it has been stored before."""
    if files_by(rows, "block"):
        return rows
    dealt = rows.repartitionById(side * side, F.col("block")).sortWithinPartitions("block", "seq")
    return durable(dealt.mapInArrow(_sorted_rows(dtype), MEETING), "blocks", by="block")


def blocks_of(pairs: DataFrame, side: int, dtype: type) -> DataFrame:
    """Pairs (center, context, weight) of a symmetric table in files of each block."""
    a, b = F.col("center"), F.col("context")
    # Left out before they reach Python, and before joins that add the weight.
    once = (a % side < b % side) | ((a % side == b % side) & (a <= b))
    return stored_blocks(pairs.where(once).mapInArrow(pair_blocks(side, dtype), MEETING), side, dtype)


def stored_parts(rows: DataFrame, side: int, *order: str) -> DataFrame:
    """Rows of a table of words in files of each part, as such a table is if it has been stored before."""
    if files_by(rows, "part"):
        return rows
    return durable(rows.repartitionById(side, F.col("part")).sortWithinPartitions("part", *order), "parts", by="part")


def plan(side: int, made: DataFrame, met: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, kind, files): for each part of `made` what it meets, all of them stored."""
    tables = files_by(made, "part"), files_by(met, "part"), files_by(blocks, "block")
    rows = []
    for block in range(side * side):
        i, j = divmod(block, side)
        if i in tables[CENTERS]:
            keys = i, j, min(i, j) * side + max(i, j)
            rows += [(block, kind, files[key]) for kind, (files, key) in enumerate(zip(tables, keys)) if key in files]
    return blocks.sparkSession.createDataFrame(rows, _PLAN)


def meet(rows: DataFrame, side: int, run: Callable, schema: str) -> DataFrame:
    """Run a function on the rows of a plan, a task for each part that is made."""
    dealt = rows.repartitionById(side, F.floor(F.col("block") / side).cast("int")).sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(run, schema)


def blocks_met(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[tuple]:
    """(i, j, files of part i, files of part j, files of their pairs) in the order of j."""
    found: dict[int, dict] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault(row["block"], {})[row["kind"]] = row["files"]
    for block in sorted(found):
        yield *divmod(block, side), *(found[block].get(kind, []) for kind in (CENTERS, CONTEXTS, PAIRS))


def stored_rows(files: list[str], *names: str) -> Iterator[tuple]:
    """Bytes of columns of stored rows."""
    for file in files:
        system, path = file_system(file)
        with system.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(_READ_ROWS, columns=list(names)):
                columns = [batch.column(name) for name in names]
                for n in range(batch.num_rows):
                    yield tuple(column[n].as_buffer() for column in columns)


def pairs_met(i: int, j: int, files: list[str], dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (word of part i, word of part j, weight) of stored pairs, sorted by the word of part i."""
    for row in stored_rows(files, "a", "b", "c"):
        ours, theirs, weight = (np.frombuffer(data, kind) for data, kind in zip(row, (np.int32, np.int32, dtype)))
        if i < j:
            yield ours, theirs, weight
            continue
        ours, theirs = theirs, ours
        if i == j:
            other = ours != theirs
            ours, theirs = np.concatenate([ours, theirs[other]]), np.concatenate([theirs, ours[other]])
            weight = np.concatenate([weight, weight[other]])
        order = np.sort(_packed(ours, np.arange(len(ours)))) & 0xFFFFFFFF
        yield ours[order], theirs[order], weight[order]


def sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys without repeats and the sums of their rows (numpy's `reduceat` takes each column by itself)."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(starts, append=len(keys))
    total, few = rows[starts], sizes <= _FEW_ROWS
    for n in range(1, _FEW_ROWS):
        more = np.flatnonzero(few & (sizes > n))
        total[more] += rows[starts[more] + n]
    for many in np.flatnonzero(~few):
        total[many] = rows[starts[many] : starts[many] + sizes[many]].sum(axis=0)
    return keys[starts], total
