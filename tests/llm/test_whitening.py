import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugarmill.llm import registry, whitening

TINY = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k=16):
    """Rows by plain numpy: {(vec_id, component): (n, deviation, |whitened|, explained)}."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in vectors}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    keep = e[:k] > e.max() * 1e-12
    e, u, trace = e[:k][keep], u[:, :k][:, keep], e.sum()
    out = {}
    for i, v in x.items():
        dev = [n * a - s for a, s in zip(v, sums, strict=True)]
        w = np.array(dev, float) / n @ u / np.sqrt(e)
        for c in range(len(e)):
            out[i, c + 1] = (n, sum(a * a for a in dev), abs(w[c]), e[c] / trace)
    return out


def same(rows, want):
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == set(want) and len(got) == len(rows)
    for key, (n, deviation, w, explained) in want.items():
        r = got[key]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(w, rel=1e-6, abs=1e-6)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_given_vectors(spark):
    rows = registry.op11_embedding_whitening(spark, TINY).collect()
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TINY}/embeddings.parquet").collect()]
    same(rows, brute([(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]))
    for c in range(1, 17):  # one sign for all rows: whitened has mean 0 over distinct vectors
        assert abs(sum(r.whitened for r in rows if r.component == c)) < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(k, [float(a) for a in rng.normal(size=3) * (3, 1, 0.2)]) for k in range(60)]
    odd = [(100, None), (101, [None, 1.0, 1.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, inf, 1.0]), (104, []), (105, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd + [(200, good[0][1]), (201, good[0][1])], SCHEMA).withColumn("x", F.lit("a")).withColumn("dim", F.lit(1))
    wide = [(k, [float(np.float32(a)) for a in v]) for k, v in [*good, (200, good[0][1]), (201, good[0][1])]]
    same(whitening.whiten(df).collect(), brute(wide))


def test_no_variance(spark):
    same_rows = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], SCHEMA)
    assert whitening.whiten(same_rows).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(5)], SCHEMA).collect()
    assert {r.component for r in whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()} == {1}


def test_repeated_ids_and_lengths(spark):
    rows = [(1, [float(k), float(k * k % 5)]) for k in range(6)] + [(2, [float(k), 1.0, float(k % 3)]) for k in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6 * 2 + 6 * 2


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [np.arange(1.0, 41), np.ones(30), np.r_[np.ones(20) * 5, np.ones(20)], np.r_[1e6, 1e3, 1.0, 1e-3, np.zeros(10)], 1 + 1e-9 * np.arange(30), np.r_[5.0, 5.0, 5.0, 4.0, np.linspace(0.1, 1, 50)], np.r_[np.zeros(5), 2.0]],
)
def test_components_of_spectra(spark, values):
    v = spectrum(values)
    v = (v + v.T) / 2
    e, u = whitening.components(spark, v, 16)
    want = np.sort(values)[::-1][:16]
    want = want[want > want[0] * len(v) * 1e-13]
    assert e == pytest.approx(want, rel=1e-10, abs=1e-12 * want[0])
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ u - u * e).max() < 1e-12 * want[0] * len(v)


def test_inertia(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 20):
        a = rng.integers(-3, 4, (n, n)).astype(float)
        a = a + a.T
        np.fill_diagonal(a, 0)
        e = np.linalg.eigvalsh(a)
        assert whitening.negatives(a) == (e < -1e-9).sum()


def test_exact_beyond_64_bits():
    x = np.array([[2**49, -(2**49)], [3, 5]], np.int64)
    n, sums = 10**6, [10**6 * 7 + 3, 11]
    dev = whitening.deviations(x, n, sums)
    assert [[int(a) for a in r] for r in dev] == [[n * int(a) - s for a, s in zip(r, sums, strict=True)] for r in x]
    assert whitening.squared(dev) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
