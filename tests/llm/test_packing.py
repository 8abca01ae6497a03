"""Packing: the schedule against a plain round-robin, pieces against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import packing
from tests.llm.fixtures import awkward_texts


def round_robin(sizes, quanta, window, grain):
    """The stream of (queue, place) by a deficit counter for each queue, token by token."""
    queues = [deque(range(n)) for n in sizes]
    deficits, stream = [0] * len(sizes), []
    while any(queues):
        for number, queue in enumerate(queues):
            deficits[number] += quanta[number]
            while queue and deficits[number] >= grain << 16:
                deficits[number] -= grain << 16
                for _ in range(min(grain, len(queue))):
                    stream.append((number, queue.popleft()))
    return stream


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 400), st.integers(1, 50)), min_size=1, max_size=5),
    st.sampled_from([(16, 1), (16, 4), (64, 8), (32, 32)]),
    st.integers(1, 60),
)
def test_schedule_equals_a_plain_round_robin(queues, shape, longest):
    window, grain = shape
    sizes, weights = [n for n, _ in queues], [w for _, w in queues]
    schedule = packing.Schedule(sizes, weights, window, grain)
    stream = round_robin(sizes, schedule.quanta.tolist(), window, grain)
    rng, docs = random.Random(1), []
    for number, n in enumerate(sizes):
        at = 0
        while at < n:
            size = min(rng.randint(1, longest), n - at)
            docs.append((number, at, size))
            at += size
    queue, at, n = (np.array(c, np.int64) for c in zip(*docs))
    found, covered = {}, Counter()
    lengths = Counter()
    for doc, start, length, number, offset in zip(*(a.tolist() for a in schedule.pieces(queue, at, n))):
        assert length > 0
        lengths[number] += length
        covered[doc] += length
        for k in range(length):
            found[number, offset + k] = (docs[doc][0], docs[doc][1] + start + k)
    assert covered == {d: size for d, (_, _, size) in enumerate(docs)}
    assert [found[key] for key in sorted(found)] == stream
    full, rest = divmod(sum(sizes), window)
    assert [lengths[k] for k in range(full)] == [window] * full
    tail = [lengths[k] for k in sorted(lengths) if k >= full]
    assert sum(tail) == rest and all(size & (size - 1) == 0 for size in tail)


def checked(rows, pieces, exact, window):
    """Every document's ids lie in its pieces, every sequence is gapless; returns tokens by sequence and source."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.source].append((p.start, p.length, p.doc_tokens, bytes(p.ids)))
        by_sequence[p.sequence_id].append((p.offset, p.length, p.source))
    want, got = Counter(), Counter()
    for name, text, source in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        want[name, source, len(ids)] += len(ids)
        for at in range(len(ids)):
            want[name, source, len(ids), at, ids[at]] += 1
    for (name, source), parts in by_doc.items():
        for start, length, n, raw in parts:
            ids = np.frombuffer(raw, "<u4").tolist()
            assert len(ids) == length
            got[name, source, n] += length
            for k, token in enumerate(ids):
                got[name, source, n, start + k, token] += 1
    assert got == want
    mixed = {}
    for number, parts in by_sequence.items():
        place, mixed[number] = 0, Counter()
        for offset, length, source in sorted(parts):
            assert offset == place
            place += length
            mixed[number][source] += length
        assert place == window or (place < window and place & (place - 1) == 0)
    assert sorted(mixed) == list(range(len(mixed)))
    return mixed


def test_pieces_hold_every_token(spark):
    exact = Tokenizer.from_file(packing.tokenizer_file())
    texts = awkward_texts() + [
        (900, "mixed <|endoftext|> text  Ᲊ \U0001f600 \x1c\x1d tabs\t\n\n end   "),
        (901, "it's a ŝtrange ΑΒΓ абв 中文字 かな 한글 '' 12,5 !!\x85\xa0x"),
    ]
    rows = [(name, text, None if n % 7 == 0 else f"s{min(n % 5, 2)}") for n, (name, text) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as queue")
    pieces = packing.pack(docs.repartition(5)).collect()
    mixed = checked(rows, pieces, exact, packing.WINDOW)
    total = Counter()
    for counts in mixed.values():
        total.update(counts)
    whole = sum(total.values())
    full = [counts for counts in mixed.values() if sum(counts.values()) == packing.WINDOW][:-1]
    for counts in full:
        for source, n in total.items():
            assert abs(counts[source] - packing.WINDOW * n / whole) <= 3 * packing.GRAIN
    small = packing.pack(docs.repartition(3), {"s1": 3.0, None: 0.5}, window=64, grain=4)
    checked(rows, small.collect(), exact, 64)


def test_digests_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    found = packing.digests(packing.pack(docs)).collect()
    end = zlib.crc32(b"\0\0\0\0")
    assert sorted((r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == [
        (0, 0, 1, end, 1), (1, 0, 1, end, 1), (1, 0, 1, end, 1),
    ]
    assert packing.pack(docs.limit(0)).count() == 0


def test_small_sources_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 3)
    rows = [(n, "word " * (n % 9 + 1), f"s{n % 12}") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = Tokenizer.from_file(packing.tokenizer_file())
    checked(rows, packing.pack(docs.repartition(4), window=64, grain=4).collect(), exact, 64)


def test_long_texts_are_cut_between_words(monkeypatch):
    encoder = packing.Encoder(packing.tokenizer_file())
    text = "one two  three\n\n four's 5 six " * 50
    whole = encoder.ids(text).tolist()
    monkeypatch.setattr(packing, "_CHUNK_CHARS", 17)
    assert encoder.ids(text).tolist() == whole == encoder.exact.encode(text, add_special_tokens=False).ids


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        packing.Schedule([1, 2], [1.0, 0.0])
