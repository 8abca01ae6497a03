"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item with an error budget of k edits is cut into k + 1 pieces. A text
that holds the item with at most k edits holds one piece unchanged, so exact
hits of pieces (one automaton over all pieces, run over each text) find every
candidate place. Each place is verified by Myers' bit-parallel search for the
item in the text around it. Documents are only mapped, never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ERROR_PERCENT = 6
# Test text in one automaton; more items make more passes over the documents.
ITEM_BYTES = 4 << 20


def normalised(text: str | None) -> str:
    """Lower case, white space folded to one blank."""
    return " ".join((text or "").lower().split())


def budget(item: str, percent: int) -> int:
    return len(item) * percent // 100


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """Start and text of `errors + 1` pieces of nearly equal length."""
    cuts = [n * len(item) // (errors + 1) for n in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(pattern: str, text: str, masks: dict[str, int]) -> tuple[int, int]:
    """Least edit distance of `pattern` to a substring of `text`, and where that ends first.

    Myers' algorithm: a column of the distance table as two bit vectors.
    """
    size = len(pattern)
    top = 1 << (size - 1)
    full = (1 << size) - 1
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, letter in enumerate(text):
        match = masks.get(letter, 0)
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, at + 1
    return best, end


class Finder:
    """All items of one automaton."""

    def __init__(self, items: list[tuple[int, str]], percent: int) -> None:
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            errors = budget(text, percent)
            masks: dict[str, int] = {}
            for at, letter in enumerate(text):
                masks[letter] = masks.get(letter, 0) | 1 << at
            for start, piece in pieces_of(text, errors):
                pieces.setdefault(piece, []).append((len(self.items), start))
            self.items.append((item_id, text, errors, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item id, distance and end (in the normalised text) of each item held, its best place."""
        candidates: dict[int, set[int]] = {}
        if len(self.automaton):
            for end, (length, places) in self.automaton.iter(text):
                for number, start in places:
                    candidates.setdefault(number, set()).add(end + 1 - length - start)
        for number, starts in sorted(candidates.items()):
            item_id, pattern, errors, masks = self.items[number]
            best, where = errors + 1, 0
            low = high = None
            for start in [*sorted(starts), None]:
                if low is not None and (start is None or start > high + len(pattern)):
                    begin = max(low - errors, 0)
                    found, end = best_match(pattern, text[begin : high + len(pattern) + errors], masks)
                    if found < best:
                        best, where = found, begin + end
                    low = None
                if start is not None:
                    low, high = start if low is None else low, start
            if best <= errors:
                yield item_id, best, where


def _item_blocks(benchmark: DataFrame, percent: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct items with text, in blocks of up to `ITEM_BYTES`, one at a time on the driver."""
    block, size = [], 0
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = normalised(row.text)
        if not text:
            continue
        block.append((row.item_id, text))
        size += len(text)
        if size > ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


_finders: dict = {}


def _finder(shared, percent: int) -> Finder:
    """The automaton of a broadcast block, built once in each worker."""
    if shared.value is not _finders.get("items"):
        _finders["finder"] = Finder(shared.value, percent)
        _finders["items"] = shared.value
    return _finders["finder"]


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """`doc_id`, `item_id`, `distance`, `end`: each test item held by a document.

    An item is held if a substring of the text is within `percent` percent of
    the item's length in edits, both lower-cased and with white space folded;
    `end` counts characters of the folded text, at the best place. Takes
    `doc_id` and `text`, and `item_id` and `text` of the benchmark. Null and
    blank texts and items hold and match nothing; repeated items count once and
    repeated documents each; a null doc_id stays null.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance int, end long"
    found = spark.createDataFrame([], schema)
    for block in _item_blocks(benchmark, percent):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            finder = _finder(shared, percent)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    rows += [(doc.as_py(), *match) for match in finder.matches(normalised(text.as_py()))]
                if rows:
                    docs_, items, distances, ends = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs_, batch.schema.field("doc_id").type),
                            pa.array(items, pa.int64()),
                            pa.array(distances, pa.int32()),
                            pa.array(ends, pa.int64()),
                        ],
                        names=["doc_id", "item_id", "distance", "end"],
                    )

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, that hold no test item. Each row is judged by its own text."""
    spark = docs.sparkSession
    schema = docs.schema
    for block in _item_blocks(benchmark, percent):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            finder = _finder(shared, percent)
            for batch in batches:
                kept = [
                    next(finder.matches(normalised(text.as_py())), None) is None for text in batch.column("text")
                ]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
