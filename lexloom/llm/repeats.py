"""Where strings of a fixed length repeat in a corpus, without all pairs.

Shared by the two operators that remove repeated passages. A text is a row of
units (words or bytes) and a window is `window` consecutive units. Each window
has a key: the least hash of the `gram`-unit strings in it. The key depends on
the content only, so equal windows have equal keys, wherever they stand, and
neighbouring windows mostly share theirs. A run is a row of neighbouring
windows with one key; its piece is the units they cover.

1. `candidate_runs` finds the runs whose key is met in more than one run. Keys
   go to buckets as packed arrays. A key met twice within a block of text is
   known to repeat, so only one witness of it is sent, however common it is.
2. `candidate_pieces` fetches the pieces of these runs. Equal pieces of a batch
   become one row with the places where they stand. If there are many, the
   places stay apart from the piece and wait for its answer.
3. `matched` hands the pieces to a matcher, all pieces of a key together. The
   matcher returns, for each window of each distinct piece, the first place
   where it starts, which gives the covered unit ranges of each place.
4. A key whose pieces exceed a shard is hot. Its pieces are dealt out again as
   single windows, by the hash of the whole window (`hot_ranges`): equal windows
   still meet, and no task has to hold the key.
5. `repeated_ranges` gathers the ranges by text.

Places are ordered by (doc_id, start); a null doc_id counts as the largest. A
text is known by (doc_id, hash of id and text), so repeated rows are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import grams
from lexloom.session import durable

LAST_ID = 2**63 - 1
MAX_RUN = 255
KEY_MASK = np.uint64(2**48 - 1)
# Units of pieces given to the matcher at once; a key of more bytes is hot.
SHARD_UNITS = 400_000
# Bytes of pieces that a task takes in between two looks for hot keys.
LOOK_BYTES = 16 << 20
# Places of one piece in a batch from which they wait apart for its answer.
MANY_PLACES = 64

RUN = np.dtype([("key", "<u8"), ("start", "<u4"), ("count", "u1")])
PLACE = np.dtype([("doc", "<i8"), ("sid", "<i8"), ("start", "<i8")])

# (pieces, docs, starts) -> per piece the arrays (first doc, first start).
Matcher = Callable[[list[bytes], np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]

# Packed columns: type and bytes kept of each value.
RUN_COLUMNS = [("<u8", 6), ("<u4", 4), ("u1", 1)]
KEY_COLUMNS = [("<u8", 6)]
HEADER_COLUMNS = [("<i8", 8), ("<i8", 8)]
HEADER, RUNS, WITNESSES, KNOWN = range(4)


@dataclass(frozen=True)
class Units:
    """What a unit is, how long windows and grams are, and whether repeats within a text count."""

    words: bool
    window: int
    gram: int
    within: bool


def named(docs: DataFrame, *more: Column) -> DataFrame:
    """`doc_id` and `text` with the numbers that name a text: `_doc` and `_sid`."""
    return docs.select(
        "doc_id",
        "text",
        *more,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_doc"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("_sid"),
    )


def packed(columns: list[tuple[str, int]], *arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, alike bytes of the values together."""
    planes = [
        np.ascontiguousarray(array.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)[:, :kept].T.tobytes()
        for (kind, kept), array in zip(columns, arrays, strict=True)
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(columns: list[tuple[str, int]], blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    count = len(raw) // sum(kept for _, kept in columns)
    arrays, at = [], 0
    for kind, kept in columns:
        wide = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
        wide[:, :kept] = raw[at : at + kept * count].reshape(kept, count).T
        arrays.append(wide.view(kind)[:, 0])
        at += kept * count
    return arrays


def _runs_of_block(data: np.ndarray, offsets: np.ndarray, units: Units):
    """Key, first unit (of all units here) and windows of each run; first unit of each text."""
    texts = len(offsets) - 1
    if units.words:
        _, _, hashes, owner = grams.words_of(data, offsets)
        begins = np.searchsorted(owner, np.arange(texts))
        return *_runs_of_units(grams.word_grams(hashes, units.gram), len(hashes), owner, units), begins
    parts = []
    step = grams.BLOCK_BYTES
    owners = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for low in range(0, len(data), step):
        high = min(low + step + units.window - 1, len(data))
        key, at, count = _runs_of_units(
            grams.byte_grams(data[low:high], units.gram), high - low, owners[low:high], units
        )
        parts.append((key, at + low, count))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, offsets[:-1]
    return *(np.concatenate(column) for column in zip(*parts, strict=True)), offsets[:-1]


def _runs_of_units(gram_hashes: np.ndarray, size: int, owner: np.ndarray, units: Units):
    windows = size - units.window + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    keys = grams.sliding_min(gram_hashes, units.window - units.gram + 1)[:windows]
    whole = owner[:windows] == owner[units.window - 1 :]
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (keys[1:] != keys[:-1]) | (owner[1:windows] != owner[: windows - 1])
    at = np.flatnonzero(opens)
    # A run ends where the next one opens or where windows stop being whole.
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | opens[1:]
    count = np.flatnonzero(closes) + 1 - at
    if len(count) and count.max() > MAX_RUN:
        parts = -(-count // MAX_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(at, parts) + nth * MAX_RUN
        count = np.minimum(np.repeat(count, parts) - nth * MAX_RUN, MAX_RUN)
    if units.within and len(at):
        at, count = _split_at_grams(gram_hashes, keys, at, count, units.window - units.gram + 1)
    return keys[at], at, count


def _split_at_grams(gram_hashes: np.ndarray, keys: np.ndarray, at: np.ndarray, count: np.ndarray, width: int):
    """Split runs so that all windows of a run hold the key's gram at one place.

    A string that repeats within a run then shows as two runs with one key.
    """
    views = np.lib.stride_tricks.sliding_window_view(gram_hashes, width)
    done = []
    while len(at):
        place = at + (views[at] == keys[at][:, None]).argmax(axis=1)
        stop = at + count
        upto = np.minimum(stop, place + 1)
        done.append((at, upto - at))
        more = upto < stop
        at, count = upto[more], (stop - upto)[more]
    at = np.concatenate([a for a, _ in done])
    count = np.concatenate([c for _, c in done])
    order = np.argsort(at, kind="stable")
    return at[order], count[order]


_SENT = "bucket int, block long, kind int, blob binary"
_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, _SENT_SCHEMA, strict=True)], schema=_SENT_SCHEMA
    )


def _key_rows(units: Units, buckets: int):
    """Of each block of texts a header, its runs by bucket and what it knows to repeat."""

    def by_bucket(bucket: np.ndarray, rows: np.ndarray):
        rows = np.sort(rows)
        rows = rows[np.argsort(bucket[rows], kind="stable")]
        numbers, first = np.unique(bucket[rows], return_index=True)
        return zip(numbers.tolist(), np.split(rows, first[1:]), strict=False)

    def steps(at: np.ndarray) -> np.ndarray:
        return np.diff(at, prepend=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in grams.text_blocks(batch, "text"):
                key, at, count, begins = _runs_of_block(*grams.buffer_of(part.column("text")), units)
                if not len(key):
                    continue
                order = np.argsort(at, kind="stable")
                key, at, count = key[order], at[order], count[order]
                block += 1
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                sent = (key // np.uint64(buckets)) & KEY_MASK
                sids = part.column("_sid").to_numpy()
                rows = [(block % buckets, block, HEADER, packed(HEADER_COLUMNS, sids, begins))]
                _, first, where, met = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                often = met[where] > 1
                for number, mine in by_bucket(bucket, np.flatnonzero(~often)):
                    blob = packed(RUN_COLUMNS, sent[mine], steps(at[mine]), count[mine])
                    rows.append((number, block, RUNS, blob))
                for number, mine in by_bucket(bucket, first[met > 1]):
                    rows.append((number, block, WITNESSES, packed(KEY_COLUMNS, sent[mine])))
                for number, mine in by_bucket(bucket, np.flatnonzero(often)):
                    blob = packed(RUN_COLUMNS, sent[mine], steps(at[mine]), count[mine])
                    rows.append((number, block, KNOWN, blob))
                yield _sent(rows)

    return run


def _repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket the runs whose key is met more than once; headers and known runs as they are."""
    held, bucket = [], 0
    for batch in batches:
        passed = []
        for row in batch.to_pylist():
            bucket, block, kind, blob = row.values()
            if kind in (HEADER, KNOWN):
                passed.append((bucket, block, kind, blob))
            elif kind == WITNESSES:
                (keys,) = unpacked(KEY_COLUMNS, blob)
                held.append((keys, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)))
            else:
                keys, gaps, counts = unpacked(RUN_COLUMNS, blob)
                held.append((keys, np.full(len(keys), block), np.cumsum(gaps, dtype=np.int64), counts))
        if passed:
            yield _sent(passed)
    if not held:
        return
    keys, blocks, at, counts = (np.concatenate(column) for column in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    kept = order[again]
    kept = kept[counts[kept] > 0]
    kept = kept[np.lexsort((at[kept], blocks[kept]))]
    numbers, first = np.unique(blocks[kept], return_index=True)
    rows = [
        (bucket, block, KNOWN, packed(RUN_COLUMNS, keys[mine], np.diff(at[mine], prepend=0), counts[mine]))
        for block, mine in zip(numbers.tolist(), np.split(kept, first[1:]), strict=False)
    ]
    if rows:
        yield _sent(rows)


def _text_runs(buckets: int):
    """Runs of each text; the rows of a block follow each other, its header first."""

    def settled(header, held):
        if header is None or not held:
            return
        sids, begins = header
        keys, at, counts = (np.concatenate(column) for column in zip(*held, strict=True))
        order = np.argsort(at, kind="stable")
        keys, at, counts = keys[order], at[order], counts[order]
        text = np.searchsorted(begins, at, "right") - 1
        runs = np.zeros(len(at), RUN)
        runs["key"], runs["start"], runs["count"] = keys, at - begins[text], counts
        texts, sizes = np.unique(text, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sids[texts]), grams.binary_rows(runs, sizes)], names=["_sid", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == HEADER:
                    yield from settled(header, held)
                    header, held = unpacked(HEADER_COLUMNS, row["blob"]), []
                    continue
                keys, gaps, counts = unpacked(RUN_COLUMNS, row["blob"])
                whole = keys * np.uint64(buckets) + np.uint64(row["bucket"])
                held.append((whole, np.cumsum(gaps, dtype=np.int64), counts))
        yield from settled(header, held)

    return run


def candidate_runs(texts: DataFrame, units: Units) -> DataFrame:
    """`_sid` and packed runs whose key is met in more than one run, a row for each text."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        texts.select("_sid", "text")
        .mapInArrow(_key_rows(units, tasks), _SENT)
        .repartitionById(tasks, "bucket")
        .mapInArrow(_repeated_runs, _SENT)
        .repartition(tasks, "block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(_text_runs(tasks), "_sid long, runs binary")
        .dropDuplicates(["_sid"])
    )


_PIECES = "bucket int, heads binary, texts binary, places binary"
_PIECES_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("heads", pa.binary()), ("texts", pa.binary()), ("places", pa.binary())]
)
# Of each piece: key, bytes, number of places, whether more places wait apart.
HEAD_COLUMNS = [("<u8", 8), ("<u4", 4), ("<u4", 4), ("u1", 1)]
PLACE_COLUMNS = [("<i8", 8), ("<i8", 8), ("<u4", 4)]
# Places that wait: hash of their piece in place of its text.
WAITING = 2


def piece_hash(piece: bytes) -> int:
    return xxhash.xxh64_intdigest(piece)


def _piece_rows(units: Units, buckets: int):
    """The distinct pieces of a batch with their places, packed by bucket of the key.

    Many places of one piece stand apart, with the hash of the piece only, in
    the bucket of a text's hash, so that they spread; one place stays with it.
    """

    def flushed(held: dict[bytes, list]):
        dealt: dict[int, list] = {}
        for piece, (key, spots) in held.items():
            many = len(spots) >= MANY_PLACES
            if many:
                named_piece = piece_hash(piece).to_bytes(8, "little")
                dealt.setdefault(spots[0][1] % buckets, []).append((key, named_piece, WAITING, spots))
                spots = [min(spots, key=lambda s: (s[0], s[2]))]
            dealt.setdefault(key % buckets, []).append((key, piece, int(many), spots))
        rows = []
        for bucket, entries in dealt.items():
            keys, pieces, kinds, places = zip(*entries, strict=True)
            heads = packed(
                HEAD_COLUMNS,
                np.array(keys, np.uint64),
                np.array([len(p) for p in pieces]),
                np.array([len(s) for s in places]),
                np.array(kinds),
            )
            flat = np.array([spot for spots in places for spot in spots], np.int64)
            texts = zstandard.ZstdCompressor(level=3).compress(b"".join(pieces))
            rows.append((bucket, heads, texts, packed(PLACE_COLUMNS, *flat.T)))
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(columns, _PIECES_SCHEMA, strict=True)],
            schema=_PIECES_SCHEMA,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            texts, blobs = batch.column("text"), batch.column("runs")
            docs, sids = batch.column("_doc").to_pylist(), batch.column("_sid").to_pylist()
            done = set()
            for n in range(batch.num_rows):
                if (docs[n], sids[n]) in done:
                    continue
                done.add((docs[n], sids[n]))
                text = (texts[n].as_py() or "").encode()
                body = text.split() if units.words else text
                runs = np.frombuffer(blobs[n].as_py(), RUN)
                for key, start, count in zip(
                    runs["key"].tolist(), runs["start"].tolist(), runs["count"].tolist(), strict=True
                ):
                    stop = start + count + units.window - 1
                    piece = b" ".join(body[start:stop]) if units.words else body[start:stop]
                    place = (docs[n], sids[n], start)
                    seen = held.get(piece)
                    if seen is None:
                        held[piece] = (key, [place])
                        size += len(piece) + 300
                    else:
                        seen[1].append(place)
                        size += 120
                if size > 64 << 20:
                    yield from flushed(held)
                    held, size = {}, 0
        if held:
            yield from flushed(held)

    return run


def candidate_pieces(texts: DataFrame, runs: DataFrame, units: Units) -> DataFrame:
    """The distinct pieces of each batch of texts, with the places they stand at."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = texts.select("_doc", "_sid", "text").join(durable(runs, "runs"), "_sid")
    return found.mapInArrow(_piece_rows(units, tasks), _PIECES)


_MATCHED = (
    "key long, hash long, places binary, docs binary, starts binary, piece binary, doc long, sid long, ranges binary"
)
_MATCHED_SCHEMA = pa.schema(
    [("key", pa.int64()), ("hash", pa.int64())]
    + [(name, pa.binary()) for name in ("places", "docs", "starts", "piece")]
    + [("doc", pa.int64()), ("sid", pa.int64()), ("ranges", pa.binary())]
)


# Windows of places looked at together.
WINDOWS_AT_ONCE = 2_000_000


def _covered(
    places: np.ndarray, counts: np.ndarray, docs: list[np.ndarray], starts: list[np.ndarray], units: Units
) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Text (`doc`, `sid`) and packed unit ranges covered at the places of pieces.

    `counts` has the number of places of each piece, `docs` and `starts` the
    first place of each of its windows.
    """
    windows = np.array([len(d) for d in docs])
    first_doc = np.concatenate(docs)
    first_start = np.concatenate(starts) if units.within else None
    piece = np.repeat(np.arange(len(counts)), counts)
    base, width = (np.cumsum(windows) - windows)[piece], windows[piece]
    ends = np.cumsum(width)
    low = 0
    while low < len(places):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + WINDOWS_AT_ONCE, "right")))
        mine, w = places[low:high], width[low:high]
        row = np.repeat(np.arange(high - low), w)
        off = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
        at = base[low:high][row] + off
        doc = mine["doc"][row]
        again = first_doc[at] < doc
        if units.within:
            again |= (first_doc[at] == doc) & (first_start[at] < mine["start"][row] + off)
        row, off = row[again], off[again]
        low = high
        if not len(row):
            continue
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (off[1:] - off[:-1] > units.window)
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(row)) - 1
        spots = mine[row[first]]
        ranges = np.column_stack([spots["start"] + off[first], spots["start"] + off[last] + units.window])
        order = np.lexsort((spots["sid"], spots["doc"]))
        yield _by_text(spots[order], ranges[order])


def _by_text(spots: np.ndarray, ranges: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ranges in the order of their texts, a row for each text."""
    heads = np.flatnonzero(_new_texts(spots))
    sizes = np.diff(np.append(heads, len(spots)))
    return pa.array(spots["doc"][heads]), pa.array(spots["sid"][heads]), grams.binary_rows(ranges.ravel(), 2 * sizes)


def _new_texts(spots: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(spots), bool)
    fresh[1:] = (spots["doc"][1:] != spots["doc"][:-1]) | (spots["sid"][1:] != spots["sid"][:-1])
    return fresh


@dataclass
class _Pieces:
    """Pieces of a bucket: their bytes one after the other, and their places likewise."""

    text: bytes
    keys: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    spots: np.ndarray

    @classmethod
    def of_row(cls, row: dict) -> _Pieces:
        docs, sids, starts = unpacked(PLACE_COLUMNS, row["places"])
        spots = np.zeros(len(docs), PLACE)
        spots["doc"], spots["sid"], spots["start"] = docs, sids, starts
        text = zstandard.ZstdDecompressor().decompress(row["texts"])
        return cls(text, *unpacked(HEAD_COLUMNS, row["heads"]), spots)

    @classmethod
    def joined(cls, held: list[_Pieces]) -> _Pieces:
        if len(held) == 1:
            return held[0]
        arrays = ([getattr(h, name) for h in held] for name in ("keys", "sizes", "counts", "kinds", "spots"))
        return cls(b"".join(h.text for h in held), *map(np.concatenate, arrays))

    def where(self, kept: np.ndarray) -> _Pieces:
        if kept.all():
            return self
        text = np.frombuffer(self.text, np.uint8)[np.repeat(kept, self.sizes)].tobytes()
        columns = (column[kept] for column in (self.keys, self.sizes, self.counts, self.kinds))
        return _Pieces(text, *columns, self.spots[np.repeat(kept, self.counts)])

    def each(self, order: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray, int]]:
        ends, stops = np.cumsum(self.sizes, dtype=np.int64), np.cumsum(self.counts, dtype=np.int64)
        for n in order.tolist():
            piece = self.text[ends[n] - int(self.sizes[n]) : ends[n]]
            yield int(self.keys[n]), piece, self.spots[stops[n] - int(self.counts[n]) : stops[n]], int(self.kinds[n])

    def hot_keys(self) -> np.ndarray:
        keys, where = np.unique(self.keys, return_inverse=True)
        return keys[np.bincount(where, weights=self.sizes, minlength=len(keys)) > SHARD_UNITS]


def _matched_rows(matcher: Matcher, units: Units):
    """Ranges of places, answers to pieces whose places wait apart, and these places as they are.

    All pieces of a key are met in one task, so that a key becomes hot for all
    of them. They leave the task as they are: with their places, or with their
    hash if these wait.
    """

    def emitted(**columns) -> pa.RecordBatch:
        count = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(count, field.type)
                if field.name not in columns
                else columns[field.name]
                if isinstance(columns[field.name], pa.Array)
                else pa.array(columns[field.name], field.type)
                for field in _MATCHED_SCHEMA
            ],
            schema=_MATCHED_SCHEMA,
        )

    def settled(held: dict[bytes, list]):
        pieces = list(held)
        spots = [np.concatenate(held[p][2]) for p in pieces]
        least = [s[np.lexsort((s["start"], s["doc"]))[0]] if len(s) > 1 else s[0] for s in spots]
        firsts = matcher(pieces, np.array([x["doc"] for x in least]), np.array([x["start"] for x in least]))
        counts = np.array([len(s) for s in spots])
        docs, starts = zip(*firsts, strict=True)
        for doc, sid, ranges in _covered(np.concatenate(spots), counts, docs, starts, units):
            yield emitted(doc=doc, sid=sid, ranges=ranges)
        asked = []
        for piece, (docs, starts) in zip(pieces, firsts, strict=True):
            key, many, _ = held[piece]
            if many:
                asked.append((signed(key), signed(piece_hash(piece)), docs.tobytes(), starts.tobytes()))
        if asked:
            keys, hashes, docs, starts = zip(*asked, strict=True)
            yield emitted(key=keys, hash=hashes, docs=docs, starts=starts)

    def signed(value: int) -> int:
        return value - 2**64 if value >= 2**63 else value

    def waiting(pieces: _Pieces):
        hashes, places = [], []
        for _, name, spots, _ in pieces.each(np.arange(len(pieces.keys))):
            hashes.append(int.from_bytes(name, "little", signed=True))
            places.append(spots.tobytes())
        yield emitted(key=pieces.keys.view(np.int64), hash=hashes, places=places)

    def passed(pieces: _Pieces, asked: set[int]):
        rows = []
        for key, piece, spots, many in pieces.each(np.arange(len(pieces.keys))):
            if not many:
                rows.append((signed(key), None, piece, spots.tobytes()))
                continue
            name = signed(piece_hash(piece))
            if name not in asked:
                asked.add(name)
                rows.append((signed(key), name, piece, None))
        for low in range(0, len(rows), HOT_AT_ONCE):
            keys, hashes, texts, places = zip(*rows[low : low + HOT_AT_ONCE], strict=True)
            yield emitted(key=keys, hash=hashes, piece=texts, places=places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[_Pieces] = []
        hot, asked = np.zeros(0, np.uint64), set()
        size, look = 0, LOOK_BYTES
        for batch in batches:
            for row in batch.to_pylist():
                pieces = _Pieces.of_row(row)
                apart = pieces.kinds == WAITING
                if apart.any():
                    yield from waiting(pieces.where(apart))
                    pieces = pieces.where(~apart)
                taken.append(pieces)
                size += len(pieces.text)
                if size > look:
                    pieces = _Pieces.joined(taken)
                    hot = np.union1d(hot, pieces.hot_keys())
                    known = np.isin(pieces.keys, hot)
                    yield from passed(pieces.where(known), asked)
                    taken = [pieces.where(~known)]
                    size = len(taken[0].text)
                    look = 2 * size + LOOK_BYTES
        if not taken:
            return
        pieces = _Pieces.joined(taken)
        taken.clear()
        known = np.isin(pieces.keys, np.union1d(hot, pieces.hot_keys()))
        yield from passed(pieces.where(known), asked)
        pieces = pieces.where(~known)
        order = np.argsort(pieces.keys, kind="stable")
        _, where = np.unique(pieces.keys, return_inverse=True)
        bound = np.bincount(where, weights=pieces.sizes)[where][order].tolist() if len(order) else []
        held: dict[bytes, list] = {}
        size, current = 0, None
        for (key, piece, mine, many), key_bytes in zip(pieces.each(order), bound, strict=True):
            if key != current:
                current = key
                # No text has more units than bytes.
                if held and size + key_bytes > SHARD_UNITS:
                    yield from settled(held)
                    held, size = {}, 0
            seen = held.get(piece)
            if seen is None:
                held[piece] = [key, bool(many), [mine]]
                size += units.window + piece.count(b" ") if units.words else len(piece)
            else:
                seen[1] |= bool(many)
                seen[2].append(mine)
        if held:
            yield from settled(held)

    return run


_WINDOWS = "bucket int, hashes binary, places binary, doc long, sid long, ranges binary"
_WINDOWS_SCHEMA = pa.schema(
    [("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())]
    + [("doc", pa.int64()), ("sid", pa.int64()), ("ranges", pa.binary())]
)
# Hot pieces in one batch, and windows of them looked at together.
HOT_AT_ONCE = 4_000
HOT_WINDOWS = 500_000


def _window_hashes(piece: bytes, units: Units) -> np.ndarray:
    """128-bit hash of each window of a piece."""
    if units.words:
        words = piece.split(b" ")
        windows = (b" ".join(words[at : at + units.window]) for at in range(len(words) - units.window + 1))
    else:
        windows = (piece[at : at + units.window] for at in range(len(piece) - units.window + 1))
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, windows)), np.uint64).reshape(-1, 2)


def _met_before(hashes: np.ndarray, spots: np.ndarray, units: Units) -> np.ndarray:
    """Which windows also start earlier, among those given."""
    order = np.lexsort((spots["start"], spots["doc"], hashes[:, 1], hashes[:, 0]))
    opens = np.ones(len(order), bool)
    opens[1:] = (hashes[order[1:]] != hashes[order[:-1]]).any(axis=1)
    mine = spots[order]
    least = mine[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    again = np.zeros(len(order), bool)
    again[order] = least["doc"] < mine["doc"]
    if units.within:
        again[order] |= (least["doc"] == mine["doc"]) & (least["start"] < mine["start"])
    return again


def _window_ranges(spots: np.ndarray, units: Units) -> pa.RecordBatch:
    """Ranges covered by single windows, a row for each text."""
    spots = spots[np.lexsort((spots["start"], spots["sid"], spots["doc"]))]
    opens = _new_texts(spots)
    opens[1:] |= spots["start"][1:] - spots["start"][:-1] > units.window
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(spots)) - 1
    ranges = np.column_stack([spots["start"][first], spots["start"][last] + units.window])
    doc, sid, ranges = _by_text(spots[first], ranges)
    none = pa.nulls(len(doc), pa.int32()), pa.nulls(len(doc), pa.binary()), pa.nulls(len(doc), pa.binary())
    return pa.RecordBatch.from_arrays([*none, doc, sid, ranges], schema=_WINDOWS_SCHEMA)


def _window_rows(units: Units, buckets: int):
    """Windows of hot pieces by bucket of their hash, without those that are met before in a batch.

    The latter are covered for certain and leave as ranges, so that a window
    met everywhere sends few places.
    """

    def settled(held: list[tuple[np.ndarray, np.ndarray]]):
        hashes = np.concatenate([np.tile(h, (len(s), 1)) for h, s in held])
        spots = np.concatenate([np.repeat(s, len(h)) for h, s in held])
        spots["start"] += np.concatenate([np.tile(np.arange(len(h)), len(s)) for h, s in held])
        again = _met_before(hashes, spots, units)
        if again.any():
            yield _window_ranges(spots[again], units)
        hashes, spots = hashes[~again], spots[~again]
        bucket = (hashes[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        numbers, first = np.unique(bucket[order], return_index=True)
        sent = [
            (number, hashes[rows].tobytes(), packed(PLACE_COLUMNS, *(spots[name][rows] for name in ("doc", "sid", "start"))))
            for number, rows in zip(numbers.tolist(), np.split(order, first[1:]), strict=False)
        ]
        columns = [pa.array(column, field.type) for column, field in zip(zip(*sent, strict=True), _WINDOWS_SCHEMA)]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.nulls(len(sent), field.type) for field in list(_WINDOWS_SCHEMA)[3:]], schema=_WINDOWS_SCHEMA
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece, places in zip(batch.column("piece"), batch.column("places"), strict=True):
                hashes = _window_hashes(piece.as_py(), units)
                spots = np.frombuffer(places.as_py(), PLACE)
                step = max(1, HOT_WINDOWS // len(hashes))
                for low in range(0, len(spots), step):
                    held.append((hashes, spots[low : low + step]))
                    size += len(hashes) * len(held[-1][1])
                    if size >= HOT_WINDOWS:
                        yield from settled(held)
                        held, size = [], 0
        if held:
            yield from settled(held)

    return run


def _first_windows(units: Units):
    """Ranges of the windows of a bucket that also start earlier; known ranges as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = [], []
        for batch in batches:
            known = batch.filter(batch.column("ranges").is_valid())
            if known.num_rows:
                yield known.select(["doc", "sid", "ranges"])
            sent = batch.filter(batch.column("ranges").is_null())
            for blob, packed_places in zip(sent.column("hashes").to_pylist(), sent.column("places").to_pylist(), strict=True):
                docs, sids, starts = unpacked(PLACE_COLUMNS, packed_places)
                spots = np.zeros(len(docs), PLACE)
                spots["doc"], spots["sid"], spots["start"] = docs, sids, starts
                hashes.append(np.frombuffer(blob, np.uint64).reshape(-1, 2))
                places.append(spots)
        if not places:
            return
        spots = np.concatenate(places)
        again = _met_before(np.concatenate(hashes), spots, units)
        if again.any():
            yield _window_ranges(spots[again], units).select(["doc", "sid", "ranges"])

    return run


def hot_ranges(pieces: DataFrame, units: Units) -> DataFrame:
    """Ranges of hot pieces (`piece`, `places`), whose windows are dealt singly by their hash."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pieces.repartition(tasks)
        .mapInArrow(_window_rows(units, tasks), _WINDOWS)
        # Known ranges have no bucket and stay spread.
        .withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("sid"), F.lit(tasks)).cast("int")))
        .repartitionById(tasks, "bucket")
        .mapInArrow(_first_windows(units), "doc long, sid long, ranges binary")
    )


def _late_ranges(units: Units):
    """Ranges of the places that waited for the answer to their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, docs, starts = (batch.column(c).to_pylist() for c in ("places", "docs", "starts"))
            if not places:
                continue
            spots = [np.frombuffer(p, PLACE) for p in places]
            covered = _covered(
                np.concatenate(spots),
                np.array([len(s) for s in spots]),
                [np.frombuffer(d, np.int64) for d in docs],
                [np.frombuffer(s, np.int64) for s in starts],
                units,
            )
            for doc, sid, ranges in covered:
                yield pa.RecordBatch.from_arrays([doc, sid, ranges], names=["doc", "sid", "ranges"])

    return run


def matched(pieces: DataFrame, matcher: Matcher, units: Units) -> DataFrame:
    """All pieces of a key through the matcher, several keys at a time."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartitionById(tasks, "bucket").mapInArrow(_matched_rows(matcher, units), _MATCHED)


def repeated_ranges(docs: DataFrame, matcher: Matcher, units: Units) -> DataFrame:
    """`_doc`, `_sid` and `ranges` (list of packed begin and end units) of texts with repeats."""
    texts = named(docs)
    pieces = candidate_pieces(texts, candidate_runs(texts, units), units)
    found = durable(matched(pieces, matcher, units), "matched")
    answers = found.where("docs IS NOT NULL").select("key", "hash", "docs", "starts")
    waiting = found.where("places IS NOT NULL AND piece IS NULL").select("key", "hash", "places")
    late = (
        waiting.join(answers, ["key", "hash"])
        .mapInArrow(_late_ranges(units), "doc long, sid long, ranges binary")
    )
    hot = found.where("piece IS NOT NULL")
    if not hot.isEmpty():
        crowds = hot.where("places IS NULL").select("key", "hash", "piece").join(waiting, ["key", "hash"])
        pieces = hot.where("places IS NOT NULL").select("piece", "places").unionByName(crowds.select("piece", "places"))
        late = late.unionByName(hot_ranges(pieces, units))
    ranges = (
        found.where("ranges IS NOT NULL")
        .select("doc", "sid", "ranges")
        .unionByName(late)
        .groupBy(F.col("doc").alias("_doc"), F.col("sid").alias("_sid"))
        .agg(F.collect_list("ranges").alias("ranges"))
    )
    return durable(ranges, "ranges")


def merged(blobs: list[bytes] | None) -> list[tuple[int, int]]:
    """Packed ranges of one text as disjoint ranges in order; touching ones become one."""
    if not blobs:
        return []
    ranges = np.concatenate([np.frombuffer(b, np.int64) for b in blobs]).reshape(-1, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    opens = np.ones(len(ranges), bool)
    opens[1:] = ranges[1:, 0] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(ranges)) - 1
    return list(zip(ranges[first, 0].tolist(), reach[last].tolist(), strict=True))
