"""Removal of repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import grams, repeats, substring_dedup, suffix_dedup
from tests.llm.fixtures import awkward_texts

LAST = 2**63


def brute_words(rows, window):
    order = {}
    split = [(i if i is not None else LAST, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for doc, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            order[key] = min(order.get(key, doc), doc)
    out = []
    for (doc_id, _), (doc, words) in zip(rows, split, strict=True):
        gone = set()
        for at in range(len(words) - window + 1):
            if order[tuple(words[at : at + window])] < doc:
                gone.update(range(at, at + window))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    first = {}
    data = [(i if i is not None else LAST, (t or "").encode()) for i, t in rows]
    for doc, text in data:
        for at in range(len(text) - length + 1):
            key = text[at : at + length]
            first[key] = min(first.get(key, (doc, at)), (doc, at))
    out = []
    for (doc_id, _), (doc, text) in zip(rows, data, strict=True):
        gone = set()
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < (doc, at):
                gone.update(range(at, at + length))
        kept = bytes(b for n, b in enumerate(text) if n not in gone)
        spans = sum(1 for n in gone if n - 1 not in gone)
        out.append((doc_id, len(text), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.selectExpr("*", "'x' as n_words", "1 as ranges", "2 as _doc")


@pytest.mark.parametrize("window", [2, 13])
def test_words_equal_brute_force(spark, window):
    rows = awkward_texts()
    found = substring_dedup.remove_repeats(table(spark, rows), window)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_words(rows, window)


def test_unchanged_texts_keep_their_form(spark):
    rows = [(1, " a  b\nc "), (2, None), (3, "")]
    found = substring_dedup.remove_repeats(table(spark, rows)).orderBy("doc_id").collect()
    assert [r.kept_text for r in found] == [" a  b\nc ", None, ""]


@pytest.mark.parametrize("length", [3, 100])
def test_bytes_equal_brute_force(spark, length):
    rows = awkward_texts()
    found = suffix_dedup.remove_repeated_bytes(table(spark, rows), length)
    got = [
        (r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found.collect()
    ]
    assert sorted(got, key=str) == brute_bytes(rows, length)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_known_spans(spark):
    docs = spark.createDataFrame([(1, "q a b c d z a b"), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([("a b c d e",), (None,), ("z a b",)], "text string")
    found = substring_dedup.known_spans(docs, known, 3).orderBy("begin").collect()
    assert [tuple(r) for r in found] == [(1, 1, 8)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab\x00c"), max_size=40), st.integers(1, 8))
def test_suffix_order(letters, depth):
    text = "".join(letters).encode()
    order = suffix_dedup.suffix_order(text, depth)
    assert sorted(order) == list(range(len(text)))
    cut = [text[at : at + depth] for at in order]
    assert cut == sorted(cut)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab\x00c"), min_size=1, max_size=40), st.integers(1, 8), st.data())
def test_order_of_wanted_suffixes(letters, depth, data):
    text = "".join(letters).encode()
    wanted = np.array(data.draw(st.lists(st.booleans(), min_size=len(text), max_size=len(text))))
    order = suffix_dedup.suffix_order(text, depth, wanted)
    assert len(set(order)) == len(order) and set(np.flatnonzero(wanted)) <= set(order) and -1 not in order
    cut = [text[at : at + depth] for at in order]
    assert cut == sorted(cut)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6), st.integers(1, 5))
def test_automaton_statistics(texts, window):
    automaton = substring_dedup.Automaton()
    texts = [[w.encode() for w in t] for t in texts]
    for doc, words in enumerate(texts):
        automaton.add(words, doc)
    automaton.finish()
    for words in texts:
        for at, (matched, doc) in enumerate(automaton.statistics(words, window)):
            assert matched == min(window, at + 1)
            if matched == window:
                want = words[at - window + 1 : at + 1]
                holds = [d for d, t in enumerate(texts) if any(t[n : n + window] == want for n in range(len(t)))]
                assert doc == min(holds)


def test_very_common_passage(spark):
    """Places of a common piece wait apart for its answer."""
    passage = " ".join(f"p{n}" for n in range(40))
    rows = [(n, f"a{n} b{n} {passage} c{n}") for n in range(400)] + [(n + 1000, passage) for n in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = substring_dedup.remove_repeats(frame)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_words(rows, 13)
    found = suffix_dedup.remove_repeated_bytes(frame)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 100)


def hot_texts(words):
    """Texts around a phrase that is the key of all windows that hold it, and copies of some of them."""
    rng = random.Random(5)
    draw = (lambda: f"w{rng.randrange(10**6)}") if words else (lambda: chr(rng.randrange(97, 123)))
    units = [draw() for _ in range(20_000)]
    gap, size = (" ", 6) if words else ("", 16)
    data = np.frombuffer(gap.join(units).encode(), np.uint8)
    if words:
        _, _, hashes, _ = grams.words_of(data, np.array([0, len(data)]))
        at = int(grams.word_grams(hashes, size).argmin())
    else:
        at = int(grams.byte_grams(data, size).argmin())
    phrase = units[at : at + size]
    around = 15 if words else 100
    texts = [[draw() for _ in range(around)] + phrase + [draw() for _ in range(around)] for _ in range(5_000)]
    rows = [(n, gap.join(t)) for n, t in enumerate(texts)]
    # Text behind the phrase, before it, whole texts, one text often, one twice in itself, an id twice, null ids.
    behind, before = (slice(around // 2, None), slice(None, around + size + around // 2))
    rows += [(10_000 + n, gap.join(["x", *texts[n][behind]])) for n in range(300)]
    rows += [(n - 20_000, gap.join([*texts[n][before], "y"])) for n in range(300, 600)]
    rows += [(30_000 + n, gap.join(texts[n])) for n in range(600, 800)]
    rows += [(40_000 + n, gap.join(texts[800])) for n in range(300)]
    rows += [(50_000, gap.join([*texts[801], *texts[801]])), (802, gap.join(texts[803])), (None, gap.join(texts[804])), (None, gap.join(texts[804]))]
    return rows


def test_hot_key(spark, monkeypatch):
    """A key whose pieces exceed a shard is split by windows, and no window is lost."""
    calls, split = [], repeats.hot_ranges
    monkeypatch.setattr(repeats, "hot_ranges", lambda pieces, units: calls.append(units.words) or split(pieces, units))
    rows = hot_texts(words=True)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = substring_dedup.remove_repeats(frame)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_words(rows, 13)
    rows = hot_texts(words=False)
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = suffix_dedup.remove_repeated_bytes(frame)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 100)
    assert calls == [True, False]


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("look", [1, 1 << 24])
def test_shards_are_bounded(monkeypatch, words, look):
    """The matcher never gets more than a shard, and all pieces reach it or leave as hot ones."""
    monkeypatch.setattr(repeats, "SHARD_UNITS", 2_000)
    monkeypatch.setattr(repeats, "LOOK_BYTES", look)
    units = repeats.Units(words=words, window=13, gram=6, within=not words)
    seen = []

    def matcher(pieces, docs, starts):
        counts = [len(p.split()) if words else len(p) for p in pieces]
        assert sum(counts) <= 2_000
        seen.extend(pieces)
        return [(np.zeros(n - 12, np.int64), np.zeros(n - 12, np.int64)) for n in counts]

    rng = random.Random(1)
    batches, sent = [], []
    for _ in range(6):
        entries = [(7 if n % 2 else n, " ".join(f"v{rng.randrange(10**6)}" for _ in range(16)).encode()) for n in range(60)]
        sent += [piece for _, piece in entries]
        keys, pieces = zip(*entries)
        heads = repeats.packed(repeats.HEAD_COLUMNS, np.array(keys), np.array([len(p) for p in pieces]), np.ones(60), np.zeros(60))
        places = repeats.packed(repeats.PLACE_COLUMNS, *np.arange(180).reshape(3, 60))
        blob = repeats.zstandard.ZstdCompressor().compress(b"".join(pieces))
        batches.append(repeats.pa.RecordBatch.from_pylist([{"bucket": 0, "heads": heads, "texts": blob, "places": places}], repeats._PIECES_SCHEMA))
    hot = []
    for batch in repeats._matched_rows(matcher, units)(iter(batches)):
        hot += [p for p in batch.column("piece").to_pylist() if p is not None]
    assert sorted(seen + hot) == sorted(sent) and len(hot) == 180
