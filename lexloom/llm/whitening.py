"""Whitening of vectors by components found with contour integration (FEAST).

Sums and covariance are gathered over all vectors in one pass each; the matrix
of a covariance has one row per dimension. Inertia counts (the signs of the
pivots of a shifted matrix) slice the wanted part of the spectrum into
intervals with a known number of eigenvalues. Each interval is searched by a task
of its own: random vectors pass through a quadrature of the resolvent along a
circle around the interval, which is one complex shifted solve per node and keeps
just the directions whose eigenvalues lie inside; a Rayleigh-Ritz step takes
eigenpairs from them, until their residuals vanish. An interval that yields fewer pairs than
its count is an error, so that no component is missed.

Entries are floored to whole numbers (`floor(scale * entry) + shift`). Sums are
exact; differences from the mean are taken as whole numbers (`n * x - S`) before
they are divided, so that a large common part costs no precision.

Rows whose vector is null, empty, or holds null or non-finite entries are left
out, and so are vectors of another length than the most frequent one (of equally
frequent ones the longest). Null and repeated ids are kept as they are.
Components without variance are not returned, as nothing can be divided by it;
one vector, or none, gives no rows. Entries saturate at 2**31. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# Eigenvalues of an interval, if its edges can be told apart.
PER_INTERVAL = 8
NODES = 12
ROUNDS = 40
GAP_STEPS = 12
# Residual of a component, and smallest variance, as parts of the largest eigenvalue.
TOLERANCE = 1e-13
LEAST_VARIANCE = 1e-10
# Groups of tasks whose matrices are added before they reach the driver.
GROUPS = 32
_LARGEST = 1 << 31
_LONG = 1 << 63
_BATCH_ROWS = 1_000


# --- whole entries -----------------------------------------------------------


def usable(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) with whole entries of the vectors that take part."""
    entry = F.col("embedding").cast("array<double>")
    finite = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & finite)

    def whole(v):
        bounded = F.greatest(F.lit(float(-_LARGEST)), F.least(F.lit(float(_LARGEST)), F.floor(v * scale).cast("double")))
        return bounded.cast("long") + shift

    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entry, whole).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (usual["length"] if usual else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, _BATCH_ROWS):
            yield batch.slice(low, _BATCH_ROWS)


# --- sums over all vectors ---------------------------------------------------


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for piece in _pieces(batches):
            x = _matrix(piece)
            n += len(x)
            # Python numbers, which have no largest one.
            part = x.sum(axis=0).astype(object)
            sums = part if sums is None else sums + part
        if n:
            yield pa.RecordBatch.from_pydict(
                {"dim": list(range(len(sums))), "n": [n] * len(sums), "total": [str(s) for s in sums]}
            )

    found = rows.select("x").mapInArrow(run, "dim long, n long, total string")
    sums = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    listed = sorted(sums.collect())
    return (listed[0]["n"], [int(row["total"]) for row in listed]) if listed else (0, [])


class Centre:
    """Differences of vectors from their mean, as whole numbers times `n`."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.middle = np.array([s // n for s in sums], np.int64)
        # n * x - S is n * (x - middle) less this.
        self.rest = np.array([s - n * (s // n) for s in sums], np.int64)

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; Python numbers where longs are too small."""
        near = x - self.middle
        if x.size and (int(np.abs(near).max()) + 1) * self.n >= _LONG:
            near, rest = near.astype(object), self.rest.astype(object)
            return near * self.n - rest
        return near * self.n - self.rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.differences(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of squares of n * x - S; null if it does not fit into a long."""
        away = self.differences(x)
        largest = int(np.abs(away).max()) if away.size else 0
        if largest * largest * max(1, x.shape[1]) < _LONG:
            return (away * away).sum(axis=1).tolist()
        found = [sum(v * v for v in line) for line in away.astype(object).tolist()]
        return [value if value < _LONG else None for value in found]


def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Count, mean and centred products of several parts together."""
    whole = None
    for n, mean, products in parts:
        if whole is None:
            whole = n, mean, products
            continue
        m, other, sums = whole
        step = mean - other
        whole = m + n, other + step * (n / (m + n)), sums + products + np.outer(step, step) * (m * n / (m + n))
    return whole


_MOMENTS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
_MOMENT_KIND = "part long, n long, mean array<double>, products array<double>"


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row in range(batch.num_rows):
        mean = batch.column("mean")[row].values.to_numpy()
        yield batch.column("n")[row].as_py(), mean, batch.column("products")[row].values.to_numpy().reshape(len(mean), -1)


def _row(whole, part: int) -> Iterator[pa.RecordBatch]:
    if whole is not None:
        n, mean, products = whole
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([n]), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])],
            schema=_MOMENTS,
        )


def covariance(rows: DataFrame, shared, values) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and covariance (divisor n) of `values(shared.value, x)` over all vectors.

    Each batch is centred on its own mean before it is multiplied; tasks pass on
    one matrix, and groups of tasks one matrix again.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for piece in _pieces(batches):
                value = values(shared.value, _matrix(piece))
                mean = value.mean(axis=0)
                away = value - mean
                yield len(value), mean, away.T @ away

        yield from _row(merged(parts()), TaskContext.get().partitionId() % GROUPS)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _row(merged(part for batch in batches for part in _read(batch)), 0)

    once = rows.select("x").mapInArrow(gather, _MOMENT_KIND).repartition(GROUPS, "part")
    last = once.mapInArrow(combine, _MOMENT_KIND)

    def local():
        for row in last.toLocalIterator():
            mean = np.array(row["mean"])
            yield row["n"], mean, np.array(row["products"]).reshape(len(mean), -1)

    whole = merged(local())
    return None if whole is None else (whole[1], whole[2] / whole[0])


# --- eigenpairs --------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: positive pivots of the shifted matrix.

    Symmetric elimination with pivots of one or two rows, chosen so that no
    multiplier grows.
    """
    a = matrix - shift * np.eye(len(matrix))
    bound = (1 + math.sqrt(17)) / 8
    positive = 0
    while len(a):
        column = np.abs(a[1:, 0])
        largest = float(column.max(initial=0.0))
        if largest == 0:
            positive += a[0, 0] > 0
            a = a[1:, 1:]
            continue
        pair = None
        if abs(a[0, 0]) < bound * largest:
            other = int(column.argmax()) + 1
            across = np.abs(a[other]).copy()
            across[other] = 0
            if abs(a[0, 0]) * across.max() >= bound * largest * largest:
                pass
            elif abs(a[other, other]) >= bound * across.max():
                swap = np.arange(len(a))
                swap[[0, other]] = other, 0
                a = a[np.ix_(swap, swap)]
            else:
                pair = other
        if pair is None:
            positive += a[0, 0] > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / a[0, 0])
            continue
        swap = np.arange(len(a))
        swap[[1, pair]] = pair, 1
        a = a[np.ix_(swap, swap)]
        # A pair chosen like this has a negative determinant: one value of each sign.
        positive += 1
        a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return int(positive)


def _gap(matrix: np.ndarray, at: float, count: int, low: float, high: float) -> float:
    """About the middle of the gap between eigenvalues around `at`, above which lie `count`, within `low` and `high`."""
    least, most = at, at
    for _ in range(GAP_STEPS):
        middle = (low + least) / 2
        low, least = (low, middle) if count_above(matrix, middle) == count else (middle, least)
        middle = (most + high) / 2
        most, high = (middle, high) if count_above(matrix, middle) == count else (most, middle)
    return (least + most) / 2


def slices(matrix: np.ndarray, many: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of intervals that hold the `many` largest eigenvalues at least.

    Intervals are halved until they hold few enough, or are too narrow to be told
    apart. Their edges lie in the middle of gaps, which makes the searches short.
    """
    radius = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if radius == 0:
        return []
    top, floor = radius * 1.001, radius * LEAST_VARIANCE
    narrow = radius * 1e-7
    low = floor
    if count_above(matrix, floor) > many:
        # The lower edge: as few eigenvalues above it as will do.
        high = top
        while high - low > narrow:
            middle = (low + high) / 2
            found = count_above(matrix, middle)
            if found >= many:
                low = middle
                if found == many:
                    break
            else:
                high = middle
    count = count_above(matrix, low)
    low = _gap(matrix, low, count, floor, top)
    waiting, found = [(low, top, count, 0)], []
    while waiting:
        low, high, above_low, above_high = waiting.pop()
        many_inside = above_low - above_high
        if many_inside > per_interval and high - low > narrow:
            middle = (low + high) / 2
            above = count_above(matrix, middle)
            if above_high < above < above_low:
                middle = _gap(matrix, middle, above, low, high)
            waiting += [(low, middle, above_low, above), (middle, high, above, above_high)]
        elif many_inside:
            found.append((low, high, many_inside))
    return sorted(found, reverse=True)


def contour(matrix: np.ndarray, low: float, high: float, many: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The `many` eigenpairs from `low` to `high`; an error if they are not all found."""
    size = len(matrix)
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    around = radius * np.exp(1j * math.pi / 2 * (points + 1))
    scale = np.abs(matrix).sum(axis=1).max()
    block = np.random.default_rng(size).normal(size=(size, min(size, many + max(4, many // 2))))
    wide = block.shape[1]
    for _ in range(ROUNDS):
        if wide < size:
            # The lower half of the circle gives the conjugate, so twice the real part is left.
            inside = np.zeros((size, wide))
            for point, weight in zip(around, weights):
                solved = np.linalg.solve((middle + point) * np.eye(size) - matrix, block)
                inside += weight / 2 * (point * solved).real
        else:
            inside = block
        basis, _ = np.linalg.qr(inside)
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turn
        residuals = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        good = (values > low) & (values <= high) & (residuals <= TOLERANCE * scale * math.sqrt(size))
        if good.sum() == many:
            return values[good], vectors[:, good]
        block = vectors
    raise ArithmeticError(f"{good.sum()} of {many} eigenvalues found from {low} to {high}")


def components(spark: SparkSession, matrix: np.ndarray, many: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their vectors as columns; intervals are searched in parallel."""
    intervals = slices(matrix, many)
    if not intervals:
        return np.zeros(0), np.zeros((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = contour(shared.value, row["low"], row["high"], row["many"])
                yield pa.RecordBatch.from_pydict({"value": values.tolist(), "vector": vectors.T.tolist()})

    frame = spark.createDataFrame(intervals, "low double, high double, many long").repartition(len(intervals))
    found = frame.mapInArrow(search, "value double, vector array<double>").collect()
    shared.unpersist()
    # Together once more: neighbours in different intervals become orthogonal.
    basis, _ = np.linalg.qr(np.array([row["vector"] for row in found]).T)
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1][:many], (basis @ turn)[:, ::-1][:, :many]


# --- whitening ---------------------------------------------------------------


def _white(fitted, x: np.ndarray) -> np.ndarray:
    centre, values, vectors = fitted[:3]
    return centre.centred(x) @ vectors / np.sqrt(values)


_OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(vectors: DataFrame, many: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    `deviation` is the sum of squares of n * x - S, null where a long is too
    small; `identity_error` is the largest entry of the covariance of all
    whitened vectors less the identity, measured over them.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale, shift)
    n, sums = totals(rows)
    if not n:
        return spark.createDataFrame([], _OUT)
    centre = Centre(n, sums)
    context = spark.sparkContext
    _, matrix = covariance(rows, context.broadcast(centre), lambda shared, x: shared.centred(x))
    values, columns = components(spark, matrix, many)
    if not len(values):
        return spark.createDataFrame([], _OUT)
    fitted = context.broadcast((centre, values, columns))
    _, white = covariance(rows, fitted, _white)
    error = float(np.abs(white - np.eye(len(values))).max())
    shares = values / np.trace(matrix)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            x = _matrix(piece)
            count, wide = len(x), len(values)
            of_row = pa.array(np.repeat(np.arange(count), wide))
            deviations = pa.array(fitted.value[0].deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("vec_id").take(of_row),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * wide, n)),
                    deviations.take(of_row),
                    pa.array(_white(fitted.value, x).ravel()),
                    pa.array(np.tile(shares, count)),
                    pa.array(np.full(count * wide, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, _OUT)
