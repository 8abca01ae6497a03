"""Near-duplicate components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import jaccard_join
from lexloom.llm.components import components
from tests.llm.fixtures import awkward_texts


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[n : n + size]) for n in range(len(words) - size + 1))


def brute(rows, percent, size):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (doc, _) in enumerate(rows):
        known = least.get(find(n))
        least[find(n)] = doc if known is None else known if doc is None else min(known, doc)
    return sorted(((d, len(s), least[find(n)] if s else d) for n, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, groups=6, size=25):
    """Groups of near copies, some of which only chain to each other."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        for _ in range(size):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
            rows.append((rng.randrange(10**6), " ".join(words)))
    shared = " ".join(f"s{n}" for n in range(30))
    rows += [(10**6 + n, shared + " " + " ".join(f"q{n}x{m}" for m in range(12 + n % 5))) for n in range(80)]
    return rows


@pytest.mark.parametrize("percent, size", [(75, 5), (60, 2)])
def test_components_equal_brute_force(spark, percent, size):
    rows = awkward_texts() + near_copies(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as name", "1 as n", "2 as root")
    found = jaccard_join.near_duplicates(frame, percent, size)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, percent, size)


def test_exact_stage_alone(spark, monkeypatch):
    """Without the stars, the prefix filters must find every link."""
    monkeypatch.setattr(jaccard_join, "STARS", 0)
    rows = awkward_texts(2) + near_copies(4)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.near_duplicates(frame)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 75, 5)


def test_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.sql("select 900L, 500L"))
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {n: 0 for n in range(201)} | {900: 500, 500: 500}


@pytest.mark.parametrize("at_once", [50, 2_000_000])
def test_copies_in_many_blocks_send_their_tokens_once(monkeypatch, at_once):
    """However many blocks hold a text, a row of it has each token once, and a set is one row."""
    monkeypatch.setattr(jaccard_join, "KNOWN_AT_ONCE", at_once, raising=False)
    token, owner, names = np.arange(40, dtype=np.uint64), np.repeat([0, 1], 20), np.array([5, 6])
    columns = ["bucket", "name", "n", "docs", "names", "owners", "keys", "held"]
    rows = []
    for _ in range(300):
        for held, part in ((jaccard_join.KNOWN, np.arange(0, 30)), (jaccard_join.ALONE, np.arange(30, 40)), (jaccard_join.WITNESS, np.arange(30, 31))):
            rows += [dict(zip(columns, row)) for row in jaccard_join._packed(token, owner, names, part, 1, held)]
    counted = list(jaccard_join._counted_rows(pa.RecordBatch.from_pylist(rows[at : at + 50]) for at in range(0, len(rows), 50)))
    sent = [(name, np.frombuffer(blob, np.uint64)) for batch in counted for name, blob in zip(batch.column("name").to_pylist(), batch.column("tokens").to_pylist())]
    assert all(len(set(keys.tolist())) == len(keys) for _, keys in sent)
    assert set(np.concatenate([k for name, k in sent if name == 6]).tolist()) == set(range(20, 31))
    assert len([name for name, _ in sent if name == 5]) <= 2 or at_once == 50


def test_repeated_tokens_of_a_set_fold_as_they_come():
    schema = pa.schema([("name", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])
    some = [np.arange(low, low + 10, dtype=np.int64).tobytes() for low in (0, 5, 10)]
    rows = [(1, 20, None)] + [(1, None, blob) for blob in some * 100] + [(2, 9, None), (3, 10, None), (3, None, some[0])]
    batches = [
        pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows[at : at + 7]], schema) for at in range(0, len(rows), 7)
    ]
    found = [row for batch in jaccard_join._sifted_rows(75)(iter(batches)) for row in batch.to_pylist()]
    assert found == [
        {"name": 1, "n": 20, "shared": list(range(20))},
        {"name": 3, "n": 10, "shared": list(range(10))},
    ]
