"""Dense vectors against numpy."""

import numpy as np
import pytest

from lexloom.operators import dense, grid


def table_of(spark, matrix):
    rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(matrix)]
    return spark.createDataFrame(rows, "center int, context int, weight double").repartition(3)


def drawn(spectrum, seed=1):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(spectrum), len(spectrum))))
    return (turn * np.array(spectrum)) @ turn.T


def as_matrix(found, n):
    rows = {r.word: np.array(r.vec) for r in found.vectors.collect()}
    return np.array([rows[k] for k in range(n)])


def test_equals_singular_vectors(spark):
    spectrum = [9.0, -7.5, 6.0, 4.5] + [1.0 / (k + 1) for k in range(36)]
    matrix = drawn(spectrum)
    found = dense.dense_vectors(table_of(spark, matrix), 4, rounds=12, tolerance=1e-9)
    left, values, _ = np.linalg.svd(matrix)
    np.testing.assert_allclose(found.values, spectrum[:4], rtol=1e-8)
    got = as_matrix(found, 40)
    want = left[:, :4] * np.sqrt(values[:4])
    signs = np.sign((got * want).sum(axis=0))
    np.testing.assert_allclose(got * signs, want, atol=1e-6)
    assert max(found.residuals) <= 1e-9 * 9


def test_of_a_counted_table(spark):
    """Weights of few kinds of words: products of the vectors give the table back, as it has low rank."""
    rng = np.random.default_rng(2)
    base = rng.random((30, 5))
    matrix = base @ base.T
    matrix[7] = matrix[:, 7] = 0
    found = dense.dense_vectors(table_of(spark, matrix), 8, tolerance=1e-10)
    rows = {r.word: np.array(r.vec) for r in found.vectors.collect()}
    assert 7 not in rows and len(found.values) == 5
    got = np.array([rows.get(k, np.zeros(5)) for k in range(30)])
    np.testing.assert_allclose(got @ got.T, matrix, atol=1e-7)


def test_without_rows(spark):
    found = dense.dense_vectors(table_of(spark, np.zeros((3, 3))), 2)
    assert found.vectors.count() == 0 and found.values == []


@pytest.mark.parametrize("rounds", [1, 3])
def test_residuals_are_those_of_the_table(spark, rounds):
    matrix = drawn(np.linspace(5, 1, 25), seed=3)
    found = dense.dense_vectors(table_of(spark, matrix), 3, rounds=rounds, tolerance=0.0, power=0.0)
    got = as_matrix(found, 25)
    np.testing.assert_allclose(np.linalg.norm(got, axis=0), 1, atol=1e-9)
    measured = np.linalg.norm(matrix @ got - got * np.array(found.values), axis=0)
    np.testing.assert_allclose(found.residuals, measured, atol=1e-6)


def test_table_times_basis_in_blocks(spark, monkeypatch):
    """Many parts, words that are no full range of numbers, long runs of one center: the product is exact, and rows that
    are shuffled are those of parts, so that no more travel than parts meet parts."""
    rng = np.random.default_rng(4)
    numbers = np.sort(rng.choice(5000, 60, replace=False))
    matrix = rng.random((60, 60)) * (rng.random((60, 60)) < 0.3)
    matrix = matrix + matrix.T + np.eye(60)
    matrix[5] = matrix[:, 5] = 1
    rows = [(int(numbers[i]), int(numbers[j]), float(v)) for (i, j), v in np.ndenumerate(matrix) if v]
    table = spark.createDataFrame(rows, "center int, context int, weight double").repartition(3)
    basis = rng.random((60, 7))
    side = 4
    blocks = table.mapInArrow(grid.pair_blocks(side, np.float64), grid.MEETING)
    held = spark.createDataFrame([(int(n), row.tolist()) for n, row in zip(numbers, basis)], "word int, row array<double>")
    met, meet = [], grid.meet
    monkeypatch.setattr(grid, "meet", lambda rows, *rest: met.append(rows.where(f"kind <> {grid.PAIRS}").count()) or meet(rows, *rest))
    found = {r.word: r.image for r in dense._times(blocks, held.coalesce(1), side, 7).collect()}
    assert sorted(found) == numbers.tolist() and met == [2 * side * side]
    np.testing.assert_allclose([found[int(n)] for n in numbers], matrix @ basis, rtol=1e-12)


def test_pairs_are_kept_one_way_and_never_shuffled_again(spark, monkeypatch):
    """A round sends names of files to its tasks; the pairs lie in the files once, and each word comes back once."""
    matrix = drawn(np.linspace(9, 1, 40))
    kept, met = [], []
    stored, meet = grid.stored_blocks, grid.meet

    def stored_once(*args):
        found = stored(*args)
        kept.append(sum(len(row.a) // 4 for row in found.collect()))
        return found

    def counted(rows, side, run, schema):
        found = meet(rows, side, run, schema)
        met.append((rows.columns, rows.count() == 3 * side * side, found.count()))
        return found

    monkeypatch.setattr(grid, "stored_blocks", stored_once)
    monkeypatch.setattr(grid, "meet", counted)
    found = dense.dense_vectors(table_of(spark, matrix), 4, rounds=2, tolerance=0.0)
    assert found.vectors.count() == 40 and set(kept) == {40 * 41 // 2}
    assert met == [(["block", "kind", "files"], True, 40)] * 2


@pytest.mark.parametrize("tasks, words, want", [(1, 10, 1), (8, 10, 4), (12, 10, 6), (8, 1_000_000, 12)])
def test_side_of_blocks(tasks, words, want):
    assert grid.side_of(words, 804, tasks) == want
