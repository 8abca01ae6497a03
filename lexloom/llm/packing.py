"""Mixture-controlled packing: deficit round-robin over the token queues of sources.

Every source has a queue: the tokens of its documents, in the order of the
input. In each round a queue's deficit grows by its quantum, its weight's part
of a window; it sends whole grains of tokens while the deficit covers them, and
carries the rest over. What the queues send, round by round and within a round
queue by queue, is one stream, cut into windows. So each window has the target
proportions but for few grains of each source, and what one window lacks the next
ones make up for.

After r rounds a queue has sent `r * quantum` rounded down to grains, or all it
has. Any task can thus tell the deficits at any place from this sum: documents
need only their place in their queue, which is a sum over the parts of the
input. Texts and tokens are not shuffled.

Nulls: a null text is empty, a null source is a source. Empty texts consist of
the end token. A row is a document, so repeated rows are packed as often as they
occur, ids may repeat or be null, and rows of one source keep the order of the
input. An empty table gives no pieces. Only the named columns are read, so that
others may have any names. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import broadcast_if_small, durable

WINDOW = 1024
GRAIN = 32
END_TOKEN = 0
# Queues of their own for the largest sources; all smaller ones share one more.
QUEUES = 1_024
PARTS_PER_GROUP = 512
STARTS_BYTES = 16 << 20
_FRACTION = 16
_CHUNK_CHARS = 1 << 20
_BATCH_BYTES = 4 << 20
_CELLS = 1 << 20

# No pre-token reaches over this place.
_CUT = re.compile(r"(?<=[0-9A-Za-z])(?= )")
# Beyond these, engines of different Unicode versions may class a character differently.
_UNCOMMON = re.compile("[^\x00-ԯ -⁤ぁ-ゖ一-龥가-힣]")


# --- tokens ------------------------------------------------------------------


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a byte-level tokenizer file, special tokens of the file included.

    Common texts go through the faster of two libraries, which reads the same
    vocabulary; a text with a special token or an uncommon character goes
    through the file's own library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        special = [token["content"] for token in stated["added_tokens"]]
        letters = _byte_of_letter()
        ranks = {
            bytes(letters[letter] for letter in token): number
            for token, number in stated["model"]["vocab"].items()
            if token not in special
        }
        self.exact = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.kind = np.dtype("<u2") if max([*ranks.values(), 0]) < 1 << 16 else np.dtype("<u4")

    def _chunk(self, text: str) -> list[int]:
        if _UNCOMMON.search(text) or self.special.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text; a long one is encoded in chunks between words."""
        chunks, low = [], 0
        while low < len(text):
            cut = _CUT.search(text, low + _CHUNK_CHARS) if len(text) > low + _CHUNK_CHARS else None
            high = cut.start() if cut else len(text)
            chunks.append(np.array(self._chunk(text[low:high]), self.kind))
            low = high
        return np.concatenate(chunks) if chunks else np.zeros(0, self.kind)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_TOKENS = pa.schema(
    [
        ("part", pa.int64()),
        ("doc_id", pa.int64()),
        ("source", pa.string()),
        ("before", pa.int64()),
        ("n", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _tokenised(path: str):
    """Ids of each document and the tokens before it in this part and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        before: dict[str | None, int] = {}
        end = np.array([END_TOKEN], encoder.kind)
        rows, held = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                few = batch.slice(low, 256)
                texts, sources, names = (few.column(name) for name in ("text", "source", "doc_id"))
                for text, source, name in zip(texts, sources.to_pylist(), names.to_pylist()):
                    ids = np.concatenate([encoder.ids(text.as_py() or ""), end])
                    place = before.get(source, 0)
                    before[source] = place + len(ids)
                    rows.append((part, name, source, place, len(ids), ids.tobytes()))
                    held += ids.nbytes
                    if held > _BATCH_BYTES:
                        yield _batch(rows, _TOKENS)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, _TOKENS)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), schema.types)], schema=schema)


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(part, doc_id, source, before, n, ids) of every document, stored.

    `ids` are little-endian, two bytes each if the vocabulary allows, and end
    with the end token; `before` counts the tokens of earlier documents of the
    same part and source.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.col("source").cast("string")
    )
    kinds = "part long, doc_id long, source string, before long, n long, ids binary"
    return durable(chosen.mapInArrow(_tokenised(path or tokenizer_file()), kinds), "tokens")


# --- the schedule ------------------------------------------------------------


class Schedule:
    """Deficit round-robin over queues of `sizes` tokens with the given weights."""

    def __init__(self, sizes: list[int], weights: list[float], window: int = WINDOW, grain: int = GRAIN):
        if any(weight <= 0 for weight in weights):
            raise ValueError("weights must be above zero, so that every token is packed")
        self.window, self.grain = window, grain
        self.sizes = np.array(sizes, np.int64)
        whole = sum(weights)
        # Deficit gained in a round, in parts of 2 ** -_FRACTION tokens.
        self.quanta = np.array([-int(-(window << _FRACTION) * w // whole) for w in weights], np.int64)
        self._grain = np.int64(grain << _FRACTION)
        self.rounds = -(-(-(-self.sizes // grain)) * self._grain // self.quanta) if len(sizes) else self.sizes
        total = int(self.sizes.sum())
        self.full = total // window
        rest, at, starts = total % window, self.full * window, []
        # The last tokens fill windows whose sizes are powers of two, so that none is padded.
        while rest:
            starts.append(at)
            at += 1 << (rest.bit_length() - 1)
            rest -= 1 << (rest.bit_length() - 1)
        self.tail = np.array(starts, np.int64)

    def sent(self, rounds: np.ndarray, queue=slice(None)) -> np.ndarray:
        """Tokens that queues have sent after so many rounds."""
        rounds = np.minimum(rounds, self.rounds[queue])
        return np.minimum(rounds * self.quanta[queue] // self._grain * self.grain, self.sizes[queue])

    def _run_starts(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Place in the stream of what each queue sends in a round."""
        found = np.zeros(len(rounds), np.int64)
        step = max(1, _CELLS // max(1, len(self.sizes)))
        for low in range(0, len(rounds), step):
            r, q = rounds[low : low + step, None], queue[low : low + step, None]
            earlier = np.arange(len(self.sizes))[None, :] < q
            found[low : low + step] = self.sent(r + earlier).sum(axis=1)
        return found

    def _window_of(self, place: np.ndarray) -> np.ndarray:
        late = self.full + np.searchsorted(self.tail, place, "right") - 1
        return np.where(place < self.full * self.window, place // self.window, late)

    def _window_start(self, number: np.ndarray) -> np.ndarray:
        ends = np.append(self.tail, int(self.sizes.sum()))
        late = ends[np.clip(number - self.full, 0, len(ends) - 1)]
        return np.where(number < self.full, number * self.window, late)

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut documents of `n` tokens at place `at` of their queue: document, start, length, window, offset."""
        first = at // self.grain
        grains = (at + n - 1) // self.grain - first + 1
        doc = np.repeat(np.arange(len(n)), grains)
        grain = np.arange(len(doc)) - np.repeat(np.cumsum(grains) - grains, grains) + first[doc]
        # The round in which the deficit first covers this grain.
        rounds = -(-(grain + 1) * self._grain // self.quanta[queue[doc]]) - 1
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rounds[1:] != rounds[:-1])]) if len(doc) else doc
        doc, rounds, grain = doc[new], rounds[new], grain[new]
        low = np.maximum(grain * self.grain, at[doc])
        last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else doc.astype(bool)
        high = np.where(last, at[doc] + n[doc], np.r_[low[1:], 0] if len(doc) else low)
        place = self._run_starts(queue[doc], rounds) + low - self.sent(rounds, queue[doc])
        # Windows that a run reaches over.
        one, many = self._window_of(place), self._window_of(place + high - low - 1)
        times = many - one + 1
        back = np.repeat(np.arange(len(doc)), times)
        number = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times) + one[back]
        begin = np.maximum(place[back], self._window_start(number))
        end = np.minimum((place + high - low)[back], self._window_start(number + 1))
        start = low[back] + begin - place[back] - at[doc[back]]
        return doc[back], start, end - begin, number, begin - self._window_start(number)


def _queues(totals: DataFrame, weights: Mapping[str | None, float] | None, other: float):
    """Named sources with a queue of their own, and the sizes and weights of all queues."""
    sizes = durable(totals.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    named = [(row["source"], row["n"]) for row in sizes.orderBy(F.desc("n"), "source").limit(QUEUES).collect()]
    rest = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in named)
    tokens_of = [n for _, n in named] + [rest] * (rest > 0)
    if weights is None:
        return [source for source, _ in named], tokens_of, tokens_of
    return [s for s, _ in named], tokens_of, [weights.get(s, other) for s, _ in named] + [other] * (rest > 0)


def _starts(totals: DataFrame, named: list[str | None]) -> DataFrame:
    """Queue of each part and source, and its tokens before this part."""
    spark = totals.sparkSession
    own = spark.createDataFrame([(s, n) for n, s in enumerate(named)], "name string, own int")
    rows = durable(
        totals.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("name")), "left").select(
            "part", "source", "n", F.coalesce("own", F.lit(len(named))).alias("queue"),
            F.floor(F.col("part") / PARTS_PER_GROUP).alias("many"),
        ),
        "places",
    )
    sums = rows.groupBy("queue", "many").agg(F.sum("n").alias("all"))
    over = Window.partitionBy("queue").orderBy("many")
    sums = sums.select("queue", "many", (F.sum("all").over(over) - F.col("all")).alias("base"))
    inside = Window.partitionBy("queue", "many").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return rows.join(sums, ["queue", "many"]).select(
        F.col("part").alias("of_part"), F.col("source").alias("of_source"), "queue", begin.alias("begin")
    )


# --- pieces ------------------------------------------------------------------

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("source", pa.string()),
        ("ids", pa.binary()),
    ]
)


def _cut(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = shared.value
        for batch in batches:
            sizes = np.cumsum(batch.column("n").to_numpy()) * 4 // _BATCH_BYTES if batch.num_rows else np.zeros(0)
            cuts = np.flatnonzero(np.diff(sizes, prepend=-1)).tolist() + [batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                yield _pieces_of(schedule, batch.slice(low, high - low), kind)

    return run


def _pieces_of(schedule: Schedule, batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    n = batch.column("n").to_numpy()
    doc, start, length, window, offset = schedule.pieces(
        batch.column("queue").to_numpy().astype(np.int64), batch.column("at").to_numpy(), n
    )
    raw = [np.frombuffer(ids, kind).astype("<u4") for ids in batch.column("ids").to_pylist()]
    ids = [raw[d][s : s + m].tobytes() for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist())]
    rows = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(rows), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(window),
            pa.array(offset), batch.column("source").take(rows), pa.array(ids, pa.binary()),
        ],
        schema=_PIECES,
    )


def pack(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    other: float = 1.0,
    window: int = WINDOW,
    grain: int = GRAIN,
    path: str | None = None,
) -> DataFrame:
    """Pieces of documents, packed into windows that hold the sources by weight.

    Gives (doc_id, start, length, doc_tokens, sequence_id, offset, source, ids):
    the ids of a piece, four little-endian bytes each, and its place. Every token
    lies in one piece. Without weights each source weighs as many tokens as it
    has, so that all windows are alike; with weights, `other` is that of sources
    they do not name, and once a source is used up the others fill the windows in
    their proportions. All windows but the last ones are full, and those are
    powers of two.
    """
    path = path or tokenizer_file()
    stored = tokens(docs, path)
    totals = stored.groupBy("part", "source").agg(F.sum("n").alias("n"))
    named, sizes, shares = _queues(totals, weights, other)
    schedule = Schedule(sizes, shares, window, grain)
    starts = broadcast_if_small(durable(_starts(totals, named), "starts"), STARTS_BYTES)
    placed = stored.join(
        starts, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source"))
    ).select("doc_id", "source", "queue", (F.col("begin") + F.col("before")).alias("at"), "n", "ids")
    shared = docs.sparkSession.sparkContext.broadcast(schedule)
    kinds = (
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"
    )
    return placed.mapInArrow(_cut(shared, _kind_of(path)), kinds)


def _kind_of(path: str) -> str:
    return _encoder(path).kind.str


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )
