"""Substring deduplication by suffix automata of reference shards.

The reference is the corpus itself, reduced to the pieces that may repeat (see
`repeats`). Each shard of it, all distinct pieces of some keys, becomes one
suffix automaton over words. Pieces are streamed through the automaton of their
shard for matching statistics: at each word the longest match, cut to the
window, and the smallest document in which that match ends. Sending each
automaton to the tasks that hold text with its keys, instead of all automata to
all tasks, keeps the work in proportion to the corpus. `known_spans` is the
plain form: a bounded reference is broadcast whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import repeats

WINDOW = 13
GRAM = 6
# Bytes of reference text in one broadcast automaton of `known_spans`.
SHARD_BYTES = 4 << 20


class Automaton:
    """Suffix automaton over words; each state knows the least document it is in."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [repeats.LAST_ID]

    def add(self, words: list[bytes], doc: int) -> None:
        after, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            known = after[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                if doc < first[last]:
                    first[last] = doc
                continue
            state = last
            if known is None:
                new = len(after)
                after.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(doc)
                while state != -1 and word not in after[state]:
                    after[state][word] = new
                    state = link[state]
                if state == -1:
                    last = new
                    continue
                known = after[state][word]
                if length[known] == length[state] + 1:
                    link[new] = known
                    last = new
                    continue
            else:
                new = -1
            copy = len(after)
            after.append(dict(after[known]))
            link.append(link[known])
            length.append(length[state] + 1)
            first.append(repeats.LAST_ID if new != -1 else doc)
            link[known] = copy
            while state != -1 and after[state].get(word) == known:
                after[state][word] = copy
                state = link[state]
            if new != -1:
                link[new] = copy
                last = new
            else:
                last = copy

    def finish(self) -> None:
        """Give each state the least document of all states below it."""
        first, link = self.first, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            above = link[state]
            if first[state] < first[above]:
                first[above] = first[state]

    def statistics(self, words: Iterable[bytes], window: int) -> Iterator[tuple[int, int]]:
        """At each word: words matched (up to `window`) and the least document of the match."""
        after, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for word in words:
            found = after[state].get(word)
            while found is None and state:
                state = link[state]
                matched = length[state]
                found = after[state].get(word)
            if found is None:
                yield 0, repeats.LAST_ID
                continue
            state = found
            matched += 1
            while length[link[state]] >= window:
                state = link[state]
            matched = min(matched, window)
            yield matched, first[state]


def shard_matcher(window: int) -> repeats.Matcher:
    def match(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray):
        automaton = Automaton()
        split = [piece.split(b" ") for piece in pieces]
        for words, doc in zip(split, docs.tolist(), strict=True):
            automaton.add(words, doc)
        automaton.finish()
        found = []
        for words in split:
            first = [doc for matched, doc in automaton.statistics(words, window) if matched == window]
            found.append((np.array(first, np.int64), np.zeros(0, np.int64)))
        return found

    return match


def _kept_rows(column: str):
    """Adds word counts, the kept text and its digest to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, texts, digests = [], [], [], []
            at = batch.schema.get_field_index(column)
            for text, blobs in zip(batch.column(at), batch.column("ranges"), strict=True):
                text = text.as_py()
                words = (text or "").encode().split()
                ranges = repeats.merged(blobs.as_py())
                kept, upto = [], 0
                for begin, end in ranges:
                    kept += words[upto:begin]
                    upto = end
                kept = kept + words[upto:] if ranges else words
                joined = b" ".join(kept)
                totals.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(joined.decode() if ranges else text)
                digests.append(hashlib.sha256(joined).hexdigest())
            rest = batch.drop_columns(["ranges"])
            arrays = rest.columns + [
                pa.array(totals, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(texts, pa.string()),
                pa.array(digests, pa.string()),
            ]
            names = rest.schema.names + ["n_words", "n_removed", "kept_text", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove words covered by a window that also starts in a smaller doc_id.

    Takes `doc_id` and `text`, returns them with `n_words`, `n_removed`,
    `kept_text` (kept words joined by a blank; the text itself if nothing goes)
    and `kept_sha256` (of the kept words joined by a blank). Windows are judged
    on the input. A null or empty text has no words; a null doc_id counts as
    the largest; rows with equal doc_id never remove each other's words; a text
    below `window` words loses nothing. Other columns are not used.
    """
    gram = max(1, min(GRAM, window - 1))
    units = repeats.Units(words=True, window=window, gram=gram, within=False)
    docs = docs.select("doc_id", "text")
    ranges = repeats.repeated_ranges(docs, shard_matcher(window), units)
    joined = (
        repeats.named(docs)
        .join(ranges, ["_doc", "_sid"], "left")
        .select("doc_id", "text", "ranges")
    )
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return joined.mapInArrow(_kept_rows("text"), schema)


def rewritten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, with the kept text in place of `text`.

    As `remove_repeats`; a text that loses nothing stays as it is, a null text
    stays null. Columns that this operator uses inside may not clash: they are
    packed away meanwhile.
    """
    gram = max(1, min(GRAM, window - 1))
    units = repeats.Units(words=True, window=window, gram=gram, within=False)
    ranges = repeats.repeated_ranges(docs.select("doc_id", "text"), shard_matcher(window), units)
    rows = repeats.named(docs, F.struct(*docs.columns).alias("_row"))
    cut = rows.join(ranges, ["_doc", "_sid"], "left").select("_row", "text", "ranges")
    row_type = cut.schema["_row"].dataType.simpleString()
    schema = f"_row {row_type}, text string, n_words long, n_removed long, kept_text string, kept_sha256 string"
    kept = cut.mapInArrow(_kept_rows("text"), schema)
    return kept.select(
        *[F.col("kept_text").alias("text") if name == "text" else F.col("_row").getField(name).alias(name) for name in docs.columns]
    )


def known_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal word spans of `docs` made of windows that stand in `reference`.

    `reference` (`text`) is cut into shards of up to `SHARD_BYTES`; each shard's
    automaton is broadcast and all documents stream through it. Returns
    `doc_id`, `begin`, `end` (words). Meant for references far smaller than the
    corpus: the corpus is read once for each shard.
    """
    spark = docs.sparkSession
    sized = reference.select("text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    found = None
    for shard in range(shards):
        texts = sized.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).select("text").distinct()
        automaton = Automaton()
        for row in texts.toLocalIterator():
            automaton.add((row.text or "").encode().split(), 0)
        automaton.finish()
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches, shared=shared):
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    words = (text.as_py() or "").encode().split()
                    hits = [
                        (at - window + 1, at + 1)
                        for at, (matched, _) in enumerate(shared.value.statistics(words, window))
                        if matched == window
                    ]
                    rows += [(doc, *span) for span in repeats.merged([np.array(hits, np.int64).tobytes()] if hits else None)]
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.int64()) for column in columns], names=["doc_id", "begin", "end"]
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, begin long, end long")
        found = part if found is None else found.unionByName(part)
    return found
