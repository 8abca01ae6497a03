"""Hard negatives against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import hard_negatives as hn

KIND = "vec_id long, label int, embedding array<double>"


def expected(rows, every, positives=hn.POSITIVES, negatives=hn.NEGATIVES, low=hn.LOW, high=hn.HIGH):
    """`rows`: (id, label, whole vector)."""
    out = []
    for a, label, x in rows:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in rows if b != a and len(y) == len(x))
        for score, b, _ in [s for s in scored if s[2] == label][:positives]:
            found = [
                (n, -s) for s, n, other in scored if other != label and low * -score <= 100 * -s <= high * -score
            ][:negatives]
            out += [(a, b, rank, n, -score, s) for rank, (n, s) in enumerate(found, 1)]
    return sorted(out)


def vectors(seed, rows, spread=6):
    rng = random.Random(seed)
    return [(n * 5, rng.randrange(3), [rng.randint(-spread, spread) for _ in range(4)]) for n in range(rows)]


@pytest.mark.parametrize("seed, spread, cut", [(1, 6, (50, 95)), (2, 1, (50, 95)), (3, 2, (40, 100))])
def test_equals_plain_python(spark, monkeypatch, seed, spread, cut):
    monkeypatch.setattr(hn, "ANCHORS", 7)
    rows = vectors(seed, 130, spread) + [(3, 1, [1, 2]), (50, 1, [0, 0])][: seed - 1]
    rows = [r for n, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:n]}]
    floats = [(n, label, [float(v) for v in x]) for n, label, x in rows]
    frame = spark.createDataFrame(floats, "vec_id long, label long, x array<double>").selectExpr("*", "1 as block", "2 as kind")
    found = hn.mine(frame.repartition(3), 10, low=cut[0], high=cut[1])
    assert found.schema.simpleString().startswith("struct<anchor_id:bigint,positive_id:bigint,rank:int")
    assert sorted(map(tuple, found.collect())) == expected(rows, 10, low=cut[0], high=cut[1])


def test_copies_of_one_vector(spark):
    """A third of the rows are one vector: ties everywhere."""
    rows = [(n, n % 2, [3.0, 4.0] if n % 3 == 0 else [float(n % 5), 3.0]) for n in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, x array<double>")
    assert sorted(map(tuple, hn.mine(frame, 50).collect())) == expected(rows, 50)


def test_rows_that_take_no_part(spark):
    rows = [
        (0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.26]), (2, 2, [0.45, 0.25]), (3, 2, None), (4, None, [1.0, 1.0]),
        (None, 1, [1.0, 1.0]), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]),
        (2, 2, [0.45, 0.25]), (2, 3, [9.0, 9.0]), (9, 2, []), (10, 2, [1.0]),
    ]
    kept = hn.quantised(spark.createDataFrame(rows, KIND), 256)
    assert sorted((r.vec_id, r.label, r.x) for r in kept.collect()) == [
        (0, 1, [128.0, 64.0]), (1, 1, [128.0, 66.0]), (2, 2, [115.0, 64.0]), (2, 2, [115.0, 64.0]),
        (2, 3, [2304.0, 2304.0]), (9, 2, []), (10, 2, [256.0]),
    ]
    whole = [(0, 1, [128, 64]), (1, 1, [128, 66]), (2, 2, [115, 64]), (9, 2, []), (10, 2, [256])]
    assert sorted(map(tuple, hn.mine(kept, 2).collect())) == expected(whole, 2) != []
    assert hn.mine(kept.limit(0), 2).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=5, max_size=5), min_size=1, max_size=4), st.integers(1, 6))
def test_best_and_windows(scores, many):
    scores = np.array(scores, np.int64)
    allowed = (np.arange(scores.size).reshape(scores.shape) % 3) > 0
    row, column = hn.best(scores, allowed, many)
    for n in range(len(scores)):
        order = sorted((-s, c) for c, s in enumerate(scores[n].tolist()) if allowed[n][c])[:many]
        assert sorted(column[row == n].tolist()) == sorted(c for _, c in order)
    windows = [[(-1, 2), (0, 0), (3, 1)]] * len(scores)
    row, column = hn.in_windows(scores, allowed, windows, many)
    for n in range(len(scores)):
        want = set()
        for low, high in windows[n]:
            order = sorted((-s, c) for c, s in enumerate(scores[n].tolist()) if allowed[n][c] and low <= s <= high)
            want |= {c for _, c in order[:many]}
        assert sorted(column[row == n].tolist()) == sorted(want)


@given(st.tuples(*[st.integers(-(2**62), 2**62)] * 3), st.tuples(*[st.integers(-(2**62), 2**62)] * 3))
def test_keys_sort_by_anchor_descending_score_and_id(a, b):
    assert hn.unpacked(hn.key(*a)) == a
    assert (hn.key(*a) < hn.key(*b)) == ((a[0], -a[1], a[2]) < (b[0], -b[1], b[2]))


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**27), 2**27, (3, 2)).astype(float)
    found = hn.products(x, x)
    assert found.tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in x] for a in x]
