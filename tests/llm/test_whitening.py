"""Whitening against numpy's eigenvalues and plain Python sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import whitening as wh

KIND = "vec_id long, embedding array<float>"


def symmetric(values, seed=1):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (turn * np.array(values)) @ turn.T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9), st.integers(-5, 5))
def test_inertia_counts_eigenvalues(values, shift):
    assert wh.count_above(symmetric(values), shift + 0.5) == sum(v > shift + 0.5 for v in values)
    assert wh.count_above(np.diag(np.array(values, float)), shift + 0.5) == sum(v > shift + 0.5 for v in values)
    hollow = symmetric(values)
    hollow[np.diag_indices(len(values))] = 0
    assert wh.count_above(hollow, 1e-3) == (np.linalg.eigvalsh(hollow) > 1e-3).sum()


SPECTRA = {
    "spread": np.linspace(1, 50, 40),
    "close": 60 + np.arange(40) * 1e-4,
    "equal": [7.0] * 30 + [3.0] * 10,
    "few": [5.0, 4.0] + [0.0] * 20,
    "one": [2.5],
    "steep": 10.0 ** -np.arange(14),
    "edge": [9.0] * 3 + [1.0] * 50,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_intervals_hold_all_components(name):
    matrix = symmetric(SPECTRA[name])
    want = np.sort(SPECTRA[name])[::-1]
    want = want[want > np.abs(matrix).sum(axis=1).max() * wh.LEAST_VARIANCE]
    found = []
    for low, high, many in wh.slices(matrix, 12):
        values, vectors = wh.contour(matrix, low, high, many)
        assert len(values) == many
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10 * want[0]
        found += values.tolist()
    assert len(found) >= min(12, len(want))
    np.testing.assert_allclose(sorted(found, reverse=True), want[: len(found)], atol=1e-11 * want[0])


def test_a_missed_component_is_an_error():
    with pytest.raises(ArithmeticError):
        wh.contour(symmetric([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]), 4.5, 6.5, 3)


def checked(found, vectors, many):
    """Compare with numpy; `vectors` are (id, entries) that take part."""
    x = np.array([[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in entries] for _, entries in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    away = x * n - sums
    centred = away.astype(float) / n
    matrix = centred.T @ centred / n
    values, columns = np.linalg.eigh(matrix)
    values, columns = values[::-1], columns[:, ::-1]
    wide = min(many, int((values > 1e-9 * values[0]).sum()))
    rows = sorted(found, key=lambda r: (r.vec_id, r.component))
    assert len(rows) == n * wide
    order = sorted(range(n), key=lambda k: vectors[k][0])
    got = np.array([r.whitened for r in rows]).reshape(n, wide)
    want = (centred @ columns[:, :wide] / np.sqrt(values[:wide]))[order]
    for c in range(wide):
        gap = min(abs(values[c] - values[k]) for k in range(len(values)) if k != c)
        if gap > 1e-6 * values[0]:
            sign = np.sign(got[:, c] @ want[:, c])
            np.testing.assert_allclose(got[:, c] * sign, want[:, c], atol=1e-7)
    assert [r.deviation for r in rows[::wide]] == [sum(v * v for v in away[k]) for k in order]
    np.testing.assert_allclose([r.explained for r in rows[:wide]], values[:wide] / np.trace(matrix), rtol=1e-9)
    errors = {r.identity_error for r in rows}
    white = got - got.mean(axis=0)
    assert len(errors) == 1 and max(errors) <= 1e-4
    assert np.abs(white.T @ white / n - np.eye(wide)).max() <= 1e-4
    assert {(r.n, type(r.component)) for r in rows} == {(n, int)}


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.3
    base[100:230] = base[7]
    rows = [(n, [float(v) for v in line]) for n, line in enumerate(base)]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    frame = spark.createDataFrame(rows + odd, KIND).selectExpr("*", "1 as x", "2 as n", "3 as component")
    checked(wh.whiten(frame.repartition(5), 6).collect(), rows, 6)
    checked(wh.whiten(frame).collect(), rows, 32)


def test_dimensions_without_variance_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(n, [float(a), float(b), float(a), 0.5]) for n, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    checked(wh.whiten(spark.createDataFrame(rows, KIND), 32).collect(), rows, 2)
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0])], KIND)
    found = wh.whiten(twice).collect()
    assert sorted(str(r.vec_id) for r in found) == ["1", "1", "None"]
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0])], KIND)).count() == 0
    assert wh.whiten(twice.limit(0)).count() == 0


def test_sums_stay_exact():
    n = 3
    x = np.array([[2**31, 5], [-(2**31), 7], [11, 2**30]], np.int64)
    centre = wh.Centre(n, x.sum(axis=0).tolist())
    away = x.astype(object) * n - x.astype(object).sum(axis=0)
    want = [sum(v * v for v in line) for line in away.tolist()]
    assert centre.differences(x).tolist() == away.tolist()
    assert centre.deviations(x) == [v if v < 2**63 else None for v in want]
    many = wh.Centre(2**40, [2**40 * 5 + 3])
    assert many.differences(np.array([[2**30]])).tolist() == [[2**70 - 2**40 * 5 - 3]]


def test_parts_of_a_covariance_add_up():
    x = np.random.default_rng(5).normal(size=(50, 3)) + 1e3
    parts = [(len(p), p.mean(axis=0), (p - p.mean(axis=0)).T @ (p - p.mean(axis=0))) for p in np.split(x, [3, 20])]
    n, mean, products = wh.merged(iter(parts))
    assert n == 50
    np.testing.assert_allclose(mean, x.mean(axis=0))
    np.testing.assert_allclose(products / n, np.cov(x.T, bias=True))
