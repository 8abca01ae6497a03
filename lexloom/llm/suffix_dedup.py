"""Removal of repeated byte strings by two-stage suffix sorting.

Texts are reduced to the pieces that may hold a repeated string (see `repeats`).
The distinct pieces of each shard become one byte sequence. Its suffixes are
compared by their first `length` bytes: those smaller than their successor are
sorted directly, the others are induced from them by a scan over the buckets of
their first byte. Neighbours in the order with a common prefix of `length`
bytes hold the same string, and the first place in each group of them is known.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm import repeats

LENGTH = 100
GRAM = 48


def suffix_order(text: bytes, depth: int, wanted: np.ndarray | None = None) -> list[int]:
    """Starts of suffixes of `text`, ordered by their first `depth` bytes or more.

    Two-stage sorting. A suffix is of the small type if it is smaller than its
    successor; these are sorted directly. A suffix of the large type follows
    its successor in the order, so one scan from the smallest to the largest
    suffix puts each into the next free place of its bucket. `wanted` marks the
    starts asked for; those that lead from them to the next small suffix take
    part too. Without it all take part.
    """
    size = len(text)
    if size == 0:
        return []
    units = np.frombuffer(text, np.uint8)
    # Type of each suffix: compare with the next byte, equal bytes inherit.
    rises = np.zeros(size, np.int8)
    rises[:-1] = np.sign(units[1:].astype(np.int16) - units[:-1].astype(np.int16))
    rises[-1] = -1
    fixed = np.where(rises != 0, np.arange(size), size)
    small = rises[np.minimum.accumulate(fixed[::-1])[::-1]] > 0
    taken = np.ones(size, bool)
    if wanted is not None:
        # From the end of each row of wanted starts on, up to a small suffix.
        last = np.flatnonzero(wanted & ~small & np.append(~wanted[1:], True))
        smalls = np.append(np.flatnonzero(small), size - 1)
        steps = np.zeros(size + 1, np.int64)
        np.add.at(steps, last, 1)
        np.add.at(steps, smalls[np.searchsorted(smalls[:-1], last)] + 1, -1)
        taken = wanted | (np.cumsum(steps[:-1]) > 0)
    chosen = np.flatnonzero(small & taken).tolist()
    cuts = [text[at : at + depth] for at in chosen]
    ranked = np.array(chosen, np.int64)[sorted(range(len(cuts)), key=cuts.__getitem__)] if cuts else np.zeros(0, np.int64)
    # In a bucket the large type comes first, then the small type.
    counts = np.bincount(units[taken], minlength=256)
    begins = np.cumsum(counts) - counts
    ends = begins + np.bincount(units[taken & ~small], minlength=256)
    order = np.full(int(taken.sum()), -1, np.int64)
    bucket = units[ranked].astype(np.int64)
    opens = np.searchsorted(bucket, np.arange(256))
    order[ends[bucket] + np.arange(len(ranked)) - opens[bucket]] = ranked
    placed = order.tolist()
    free = begins.tolist()
    # Suffixes to induce, by their successor.
    induced = (taken & ~small)[:-1].tolist()
    if taken[-1]:
        # The empty suffix is the smallest; it induces the last one.
        placed[free[text[-1]]] = size - 1
        free[text[-1]] += 1
    for rank in range(len(placed)):
        before = placed[rank] - 1
        if before >= 0 and induced[before]:
            byte = text[before]
            placed[free[byte]] = before
            free[byte] += 1
    return placed


def shard_matcher(length: int) -> repeats.Matcher:
    def match(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray):
        sizes = np.array([len(piece) for piece in pieces])
        begins = np.cumsum(sizes) - sizes
        text = b"".join(pieces)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inside = np.arange(len(text)) - begins[owner]
        whole = inside + length <= sizes[owner]
        order = np.array(suffix_order(text, length, whole))
        order = order[whole[order]]
        strings = [text[at : at + length] for at in order.tolist()]
        # Common prefix with the suffix before: `length` or less.
        same = np.fromiter(map(operator.eq, strings[1:], strings[:-1]), bool, len(strings) - 1)
        group = np.concatenate([[0], np.cumsum(~same)])
        doc = docs[owner[order]]
        place = starts[owner[order]] + inside[order]
        ranked = np.lexsort((place, doc, group))
        heads = ranked[np.searchsorted(group[ranked], np.arange(group[-1] + 1))]
        first_doc = np.zeros(len(text), np.int64)
        first_start = np.zeros(len(text), np.int64)
        first_doc[order] = doc[heads][group]
        first_start[order] = place[heads][group]
        windows = sizes - length + 1
        return [
            (first_doc[b : b + n], first_start[b : b + n])
            for b, n in zip(begins.tolist(), windows.tolist(), strict=True)
        ]

    return match


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, spans, kept_bytes, digests = [], [], [], [], []
        for text, blobs in zip(batch.column("text"), batch.column("ranges"), strict=True):
            data = (text.as_py() or "").encode()
            ranges = repeats.merged(blobs.as_py())
            kept, upto = [], 0
            for begin, end in ranges:
                kept.append(data[upto:begin])
                upto = end
            left = b"".join([*kept, data[upto:]]) if ranges else data
            totals.append(len(data))
            removed.append(len(data) - len(left))
            spans.append(np.array(ranges, np.int64).reshape(-1, 2).tolist())
            kept_bytes.append(left)
            digests.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(totals, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array(kept_bytes, pa.binary()),
                pa.array(digests, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
        )


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove bytes covered by a `length`-byte string that also starts earlier.

    Earlier means a smaller doc_id, or the same doc_id and a smaller start.
    Takes `doc_id` and `text` (UTF-8), returns `doc_id`, `n_bytes`, `n_removed`,
    `spans` (maximal removed byte ranges), `kept` (the bytes that remain, which
    may split a character) and `kept_sha256`. A null text is empty; a null
    doc_id counts as the largest; texts below `length` bytes lose nothing. Of
    repeated rows with one doc_id, none is earlier than the other, so they only
    lose what repeats inside them. Other columns are not used.
    """
    gram = max(1, min(GRAM, length - 1))
    units = repeats.Units(words=False, window=length, gram=gram, within=True)
    docs = docs.select("doc_id", "text")
    ranges = repeats.repeated_ranges(docs, shard_matcher(length), units)
    joined = repeats.named(docs).join(ranges, ["_doc", "_sid"], "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        _kept_rows,
        f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string",
    )
