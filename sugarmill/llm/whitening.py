"""Whitening of embeddings by a FEAST eigensolver.

The covariance of all distinct vectors is summed by Spark. Its leading components come from contour integrals: Sylvester's law
of inertia says how many eigenvalues lie above a point, so the upper end of the spectrum is cut into intervals of few
eigenvalues each, where all of them are accounted for. Every interval is one row and one task: a filter is applied to a random
subspace by quadrature of complex shifted solves over a circle on the interval, Rayleigh-Ritz extracts the components
from the filtered subspace, and that is repeated until they are exact and as many as the inertia counts say.

Vectors are fixed-point numbers ``floor(scale * c) + shift``, so sums and squared deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import written
from sugarmill.llm.embedding_join import matrix

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Quadrature points on a half circle; eigenvalues of an interval, unless they lie too close to be parted; rounds of the filter.
POINTS, CROWD, ROUNDS = 8, 8, 12
#: Longest vectors, as their covariance (128 MB then) goes to every task that solves; largest component of a vector.
LONGEST, LARGEST = 4096, 2.0**50


@dataclass
class Whitening:
    """Components of one length of vectors: n fitted vectors, their sums, unit eigenvectors as columns by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = float("nan")


def negatives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative: by a factorisation with diagonal blocks of one or two rows,
    pivots chosen from the whole rest (a block of two has one eigenvalue of each sign)."""
    a, count = a.copy(), 0
    while (n := len(a)) > 0:
        diagonal = np.abs(a.diagonal())
        p = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        top = off.max()
        if diagonal[p] >= 0.6404 * top:  # (1 + sqrt(17)) / 8
            if diagonal[p] == 0:
                return count
            rest = np.arange(n) != p
            count += a[p, p] < 0
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p] / a[p, p], a[p, rest])
        else:
            i, j = np.unravel_index(off.argmax(), off.shape)
            rest = (np.arange(n) != i) & (np.arange(n) != j)
            two = np.ix_([i, j], [i, j])
            count += 1
            side = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[two], side.T)
    return int(count)


def above(v: np.ndarray, at: float) -> int:
    """How many eigenvalues lie above a point."""
    return negatives(at * np.eye(len(v)) - v)


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between), from the top, that hold the ``k`` largest eigenvalues above rounding error; cut by inertia
    counts so that each holds few, unless they lie too close to be parted."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue lies above
    if top == 0:
        return []
    floor = top * len(v) * 1e-14
    counts = {top: 0, floor: above(v, floor)}
    want = min(k, counts[floor])
    if not want:
        return []

    def count(at: float) -> int:
        if at not in counts:
            counts[at] = above(v, at)
        return counts[at]

    low, high = floor, top  # at least as many as wanted lie above low, fewer above high
    while high - low > 1e-13 * top and count(low) > want + CROWD // 2:
        at = (low + high) / 2
        low, high = (at, high) if count(at) >= want else (low, at)
    out, open_ = [], [(low, top)]
    while open_:
        a, b = open_.pop()
        inside = count(a) - count(b)
        if inside and (b > 8 * a or inside > CROWD and b - a > 1e-10 * top):
            at = float(np.sqrt(a * b)) if b > 8 * a else (a + b) / 2  # small eigenvalues are found to their own precision
            open_ += [(a, at), (at, b)]
        elif inside:
            out.append((a, b, inside))
    return out


def rayleigh_ritz(v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of ``v`` within the span of a basis."""
    q = np.linalg.qr(basis)[0]
    q = np.linalg.qr(q)[0]
    values, small = np.linalg.eigh(q.T @ v @ q)
    return values, q @ small


def contour(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in (low, high) and their vectors; an error where they are not as many as ``inside``. Where others lie so close
    outside that the filter does not part them, the subspace grows."""
    d = len(v)
    size = min(d, inside + max(inside // 2, 4))
    while True:
        values, y, exact = filtered(v, low, high, inside, size)
        if exact:
            return values, y
        if size == d:
            raise ArithmeticError(f"{len(values)} of {inside} components found between {low} and {high}")
        size = min(d, 2 * size)


def filtered(v: np.ndarray, low: float, high: float, inside: int, size: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The eigenvalues in (low, high) that a subspace of one size holds after rounds of filter and Rayleigh-Ritz, their vectors, and
    whether they are exact and as many as ``inside``."""
    d = len(v)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    centre, radius = (low + high) / 2, (high - low) / 2
    y = np.random.default_rng(d * 1009 + inside).standard_normal((d, size))
    top = np.abs(v).sum(axis=1).max()
    for _ in range(ROUNDS):
        q = np.zeros((d, size))
        for t, w in zip(turn, weights, strict=True):
            q += w / 2 * radius * (t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y.astype(complex))).real
        values, y = rayleigh_ritz(v, q)
        there = (values > low) & (values < high)
        rest = np.abs(v @ y[:, there] - y[:, there] * values[there]).max() if there.any() else 0.0
        exact = bool(there.sum() == inside and rest <= max(1e-12 * high, 1e-15 * top) * np.sqrt(d))
        if exact or size == d:
            break
    return values[there], y[:, there], exact


def components(spark, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues above rounding error and their unit eigenvectors as columns; a task for each interval."""
    d = len(v)
    asked = intervals(v, k)
    if not asked:
        return np.zeros(0), np.zeros((d, 0))
    sent = spark.sparkContext.broadcast(v)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values, vectors = contour(sent.value, low, high, inside)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame(asked, "low double, high double, inside int").repartition(len(asked), "low", "high")
    found = rows.mapInArrow(solve, "value double, vector array<double>").collect()  # k components or a few more
    values, vectors = rayleigh_ritz(v, np.array([r["vector"] for r in found]).T)
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order]


def fixed(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, dim) of the rows whose vector is neither null nor empty and holds neither null nor non-finite nor, for exact sums,
    overly large entries."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale)
    good = rows.filter((F.size("c") > 0) & F.forall("c", fits))
    return good.select("vec_id", F.transform("c", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"), F.size("c").alias("dim"))


def whole(column: pa.ListArray, dim: int) -> np.ndarray:
    """The rows of a list column of integers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact; Python integers where 64 bits are not enough."""
    mean = np.array([s // n for s in sums], np.int64)
    rest = [s - n * (s // n) for s in sums]
    y = x - mean
    if y.size and float(np.abs(y).max()) * n < 2.0**62:
        return y * n - np.array(rest, np.int64)
    return y.astype(object) * n - np.array(rest, object)


def squared(dev: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if dev.dtype != object and dev.size and float(np.abs(dev).max()) ** 2 * dev.shape[1] < 2.0**62:
        return (dev * dev).sum(axis=1).tolist()
    return [sum(int(a) * int(a) for a in row) for row in dev]


def summed(rows: DataFrame, dim: int, kind: str, of) -> list:
    """The sums over all rows of the numbers that ``of`` gives for a matrix of fixed-point vectors; a fixed number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(whole(batch.column(0), dim))
                total = part if total is None else total + part
        if total is not None:
            values = [int(a) for a in total] if kind.startswith("decimal") else total
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64())], names=["at", "s"])

    out = {r["at"]: r["s"] for r in rows.select("x").mapInArrow(run, f"at int, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    return [out[k] for k in range(len(out))]


def fit(fitted: DataFrame, dim: int, k: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors ``x`` of one length. The covariance is of centred vectors, divided by their number."""
    if dim > LONGEST:
        raise ValueError(f"vectors have at most {LONGEST} components")
    n = fitted.count()
    sums = [int(s) for s in summed(fitted, dim, "decimal(38,0)", lambda x: x.astype(object).sum(axis=0) if float(np.abs(x).max()) * len(x) >= 2.0**62 else x.sum(axis=0))]

    def products(x: np.ndarray) -> np.ndarray:
        y = (deviations(x, n, sums) / n).astype(np.float64)
        return (y.T @ y).ravel()

    v = np.array(summed(fitted, dim, "double", products)).reshape(dim, dim) / n
    v = (v + v.T) / 2
    values, vectors = components(fitted.sparkSession, v, k)
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    found = len(values)
    if found:

        def moments(x: np.ndarray) -> np.ndarray:
            w = projected(model, deviations(x, n, sums))
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        m = np.array(summed(fitted, dim, "double", moments)) / n
        model.identity_error = float(np.abs(m[found:].reshape(found, found) - np.outer(m[:found], m[:found]) - np.eye(found)).max())
    return model


def projected(model: Whitening, dev: np.ndarray) -> np.ndarray:
    """Whitened rows: centred vectors on the components, each over the root of its eigenvalue."""
    return (dev / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.values)


def apply(model: Whitening, rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of (vec_id, x) rows for each component."""
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                size = piece.num_rows
                dev = deviations(whole(piece.column(1), dim), model.n, model.sums)
                ids = piece.column(0).take(pa.array(np.repeat(np.arange(size), k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, model.n)), pa.array([s for s in squared(dev) for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(projected(model, dev).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, APPLIED)


APPLIED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``APPLIED`` rows of every usable vector for each of up to ``k`` components, by falling eigenvalue.

    Each distinct fixed-point vector is fitted once, however often it occurs. Vectors that are null or empty or hold null, non-finite
    or overly large entries are dropped. Vectors of each length are fitted apart. Components without variance are left out, so equal
    vectors alone give no rows, and neither does an empty table. Repeated rows and ids come out each; other columns are left out.
    """
    rows = fixed(vectors, scale, shift, id_col, vector_col)
    fitted = written(rows.select("x", "dim").distinct())
    out = None
    for r in fitted.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row for each length
        dim = r["dim"]
        model = fit(fitted.filter(F.col("dim") == dim).select("x"), dim, k)
        one = apply(model, rows.filter(F.col("dim") == dim), dim)
        out = one if out is None else out.unionByName(one)
    return vectors.sparkSession.createDataFrame([], APPLIED) if out is None else out
