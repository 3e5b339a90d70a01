"""Whitening of embeddings: each row on the leading eigenvectors of the covariance, at unit variance.

Spark sums and centres; only the covariance (a square of the dimension) comes to the driver.  Its
leading eigenvalues are isolated by spectrum slicing: the inertia of an LDL' factorisation of the
shifted covariance says how many eigenvalues lie above a shift.  Rayleigh quotient iteration then
converges cubically inside an interval of one, and two more counts certify the eigenvalue's number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import load, prepare, stage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 62
"""Grid values must fit a long; rows with larger ones take no part."""
EPS = float(np.finfo(np.float64).eps)
SAME = 1e-9
"""Eigenvalues nearer than this part of the norm are one cluster, solved in its own small space."""
TASK_ROWS = 4096


# --- eigenvalues by inertia -------------------------------------------------------------------

def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric ``a`` exceed ``shift``: positive pivots of LDL' of ``a - shift``.

    Pivots are of size one or two (Bunch and Kaufman's choice), so that no pivot is small against
    its column; an exact zero counts as not above.
    """
    m = a - shift * np.eye(len(a))
    alpha, above = (1 + 17 ** 0.5) / 8, 0
    while len(m):
        n = len(m)
        if n == 1:
            return above + int(m[0, 0] > 0)
        column = np.abs(m[1:, 0])
        r = 1 + int(column.argmax())
        largest = column[r - 1]
        if largest == 0:
            above += int(m[0, 0] > 0)
            m = m[1:, 1:]
            continue
        if abs(m[0, 0]) < alpha * largest:
            other = np.abs(m[r])
            other[r] = 0
            sigma = other.max()
            if abs(m[0, 0]) * sigma < alpha * largest ** 2:
                order = np.arange(n)
                if abs(m[r, r]) >= alpha * sigma:
                    order[[0, r]] = r, 0
                else:                                                   # a pivot of two
                    order[[1, r]] = r, 1
                    m = m[np.ix_(order, order)]
                    two, rest = m[:2, :2], m[2:, :2]
                    above += 1                                          # its determinant is negative
                    m = m[2:, 2:] - rest @ np.linalg.solve(two, rest.T)
                    m = (m + m.T) / 2
                    continue
                m = m[np.ix_(order, order)]
        above += int(m[0, 0] > 0)
        m = m[1:, 1:] - np.outer(m[1:, 0], m[1:, 0] / m[0, 0])
    return above


def _solve(a: np.ndarray, shift: float, b: np.ndarray, norm: float) -> np.ndarray:
    """(a - shift)^-1 b; a shift that is an eigenvalue to the last bit is moved by rounding error."""
    eye = np.eye(len(a))
    for nudge in (0.0, EPS, 16 * EPS, 256 * EPS):
        try:
            x = np.linalg.solve(a - (shift + nudge * norm) * eye, b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    raise np.linalg.LinAlgError("the shifted matrix can't be solved")


def _rayleigh(a: np.ndarray, low: float, high: float, norm: float, rng) -> tuple[float, np.ndarray] | None:
    """Eigenpair with its value between the bounds, or None if the iteration left them."""
    v = rng.standard_normal(len(a))
    shift = (low + high) / 2
    for step in range(12):
        v = _solve(a, shift, v, norm)
        v /= np.linalg.norm(v)
        value = float(v @ a @ v)
        if not low < value <= high:
            if step > 2:
                return None
            continue                                     # inverse iteration until the quotient is inside
        if np.linalg.norm(a @ v - value * v) <= 8 * EPS * norm * len(a) ** 0.5:
            return value, v
        shift = value if step else shift
    return (value, v) if low < value <= high and np.linalg.norm(a @ v - value * v) <= 1e-12 * norm else None


def _cluster(a: np.ndarray, low: float, high: float, size: int, norm: float, rng) -> list[tuple[float, np.ndarray]]:
    """Eigenpairs of a cluster: its space by inverse iteration, then the same slicing within it."""
    basis = np.linalg.qr(rng.standard_normal((len(a), size)))[0]
    for _ in range(4):
        basis = np.linalg.qr(_solve(a, (low + high) / 2, basis, norm))[0]
    small = basis.T @ a @ basis
    centre = float(np.trace(small)) / size
    small = (small + small.T) / 2 - centre * np.eye(size)
    if np.abs(small).max() <= 64 * EPS * norm:           # equal to rounding: every basis will do
        return [(centre, basis[:, i]) for i in range(size)]
    return [(centre + e, basis @ u) for e, u in zip(*_pairs(small, size), strict=True)]


def _pairs(a: np.ndarray, k: int) -> tuple[list[float], list[np.ndarray]]:
    norm = float(np.abs(a).sum(1).max())
    rng = np.random.default_rng(13)
    radius = np.abs(a).sum(1) - np.abs(np.diag(a))
    low = float((np.diag(a) - radius).min()) - 4 * EPS * norm
    high = float((np.diag(a) + radius).max()) + 4 * EPS * norm
    found: list[tuple[float, np.ndarray]] = []
    todo = [(low, len(a), high, 0)]                      # bounds with the numbers of eigenvalues above them
    while todo and len(found) < k:
        low, many, high, few = todo.pop()
        if many == few:
            continue
        pair = _rayleigh(a, low, high, norm, rng) if many - few == 1 else None
        if pair is not None:
            margin = 64 * EPS * norm
            if count_above(a, pair[0] - margin) >= few + 1 >= count_above(a, pair[0] + margin) + 1:
                found.append(pair)                       # certified: it is number few + 1
                continue
        if high - low <= SAME * norm:
            found += sorted(_cluster(a, low, high, many - few, norm, rng), key=lambda p: -p[0])
            continue
        middle = (low + high) / 2
        between = count_above(a, middle)
        todo += [(low, many, middle, between), (middle, between, high, few)]
    found = found[:k]
    return [e for e, _ in found], [v for _, v in found]


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of a symmetric matrix and unit eigenvectors, as columns."""
    a = (a + a.T) / 2
    k = min(k, len(a))
    if k == 0 or not np.abs(a).max() > 0:
        return np.zeros(k), np.eye(len(a))[:, :k]
    values, vectors = _pairs(a, k)
    # rounding leaves near neighbours a little of each other; as their values are near, taking it off is harmless
    return np.array(values), np.linalg.qr(np.stack(vectors, 1))[0]


# --- sums over the rows -----------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of an array."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values.reshape(len(column), -1)


def grid_rows(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: str | None = None) -> DataFrame:
    """(id, x): vectors on the integer grid, without those that can't take part."""
    entries = F.col(f"`{vec_col}`").cast("array<double>")
    given = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), entries.alias("c"))
    bound = F.lit(float(LARGEST // SCALE))
    # null entries and those that are no number fail the comparison
    whole = F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda e: F.coalesce(F.abs(e) < bound, F.lit(False)))
    x = F.transform("c", lambda e: F.floor(e * SCALE) + SHIFT)
    return given.filter(whole).select("vec_id", x.cast("array<long>").alias("x"))


class Model(NamedTuple):
    """n distinct vectors with sums per dimension, leading eigenvalues and eigenvectors, and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part of the mean is taken off exactly, in whole numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exactly; null where a long can't hold one."""
        rough = ((self.n * self.centred(x)) ** 2).sum(1)
        if rough.max(initial=0.0) < 2.0 ** 62 and self.n * (float(np.abs(x).max(initial=0)) + 1) < 2.0 ** 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def _partial_products(fit: DataFrame, rows_of, width: int) -> np.ndarray:
    """Sum of the products of all rows' numbers, by Spark: one square of partial sums a task.

    Each task sends ``width`` rows; they are added up by row number, so that no task gets more than
    one row of the square from each.
    """
    slots = 4 * fit.sparkSession.sparkContext.defaultParallelism

    def products(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in parts:
            for begin in range(0, part.num_rows, TASK_ROWS):
                rows = rows_of(_matrix(part.column(0).slice(begin, TASK_ROWS)))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], names=["i", "part"])

    def add(rows: pa.Table) -> pa.Table:
        whole = _matrix(rows.column("part").combine_chunks()).sum(0)
        return pa.table({"i": rows.column("i").slice(0, 1), "part": pa.array([whole], pa.list_(pa.float64()))})

    kind = "i int, part array<double>"
    out = fit.select("x").coalesce(slots).mapInArrow(products, kind).groupBy("i").applyInArrow(add, kind)
    square = np.zeros((width, width))
    for row in out.toLocalIterator():
        square[row["i"]] = row["part"]
    return square


def fit_model(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """Model of a written table of distinct vectors ``x`` of one length; None if it is empty."""
    sums = (fit.select(F.posexplode("x").alias("i", "v")).groupBy("i")
            .agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect())
    if not sums:
        return None
    n, width = sums[0]["n"], len(sums)
    flat = Model(n, tuple(int(r["s"]) for r in sums), np.zeros(0), np.zeros((width, 0)), 0.0)
    covariance = _partial_products(fit, flat.centred, width) / n
    values, vectors = leading_eigenpairs(covariance, components)
    trace = float(np.trace(covariance))
    some = values > width * EPS * trace                  # a direction without variance can't be whitened
    return flat._replace(values=values[some], vectors=vectors[:, some], trace=trace)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Defined results: vectors that are null or empty or hold null or non-finite entries (or entries
    beyond the integer grid) take no part, nor do those of another length than the most frequent one
    (the longest of equally frequent ones); null ids are kept, repeated rows give a row each, and the fit takes each distinct
    vector once.  Components without variance (fewer distinct vectors than components, or
    constant dimensions) are not returned, so a table of one distinct vector gives no rows, like an
    empty one.  Components of equal eigenvalues are some orthonormal basis of their space, the same
    for all rows.  ``deviation`` is null where a long can't hold it.  Other columns are ignored.
    """
    spark = prepare(embeddings.sparkSession)
    rows = grid_rows(embeddings, id_col, vec_col)
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if width is None:
        return spark.createDataFrame([], kind)
    rows = rows.filter(F.size("x") == width["d"])
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    model = fit_model(fit, components)
    k = len(model.values)
    if k == 0:
        return spark.createDataFrame([], kind)
    identity = _partial_products(fit, model.whiten, k) / model.n - np.eye(k)
    error = float(np.abs(identity).max())
    explained = model.values / model.trace

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, TASK_ROWS):
                some = part.slice(begin, TASK_ROWS)
                x = _matrix(some.column(1))
                m = len(x)
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    some.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(at),
                    pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], names=[c.split()[0] for c in kind.split(", ")])

    return rows.mapInArrow(project, kind)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading components of every embedding."""
    return whiten(load(spark, sf_dir, "embeddings"))
