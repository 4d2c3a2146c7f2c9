import numpy as np

from sugarmill.llm import embedding_join as ej
from tests.llm.test_ngram_join import roots


def brute(vectors, least=0.9):
    n = len(vectors)
    x = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, np.float64) for v in vectors]
    pairs = [(i, j) for i in range(n) for j in range(i) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least]
    links = np.zeros(n, int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    r = roots(n, pairs)
    return {i: (int(links[i]), r[i], r[i] == i) for i in range(n)}


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ej, "BLOCK", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12))
    vectors = [np.float32(centres[rng.integers(40)] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.6])).tolist() for _ in range(700)]
    vectors[50:120] = [vectors[3]] * 70
    vectors += [None, [], [0.0] * 12, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], [v * 3 for v in vectors[3]], [1e-30] * 12, [1e30] * 12]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").selectExpr("vec_id", "cast(embedding as array<float>) embedding", "1 as rep")
    rows = df.collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ej.join(df.repartition(3)).collect()}
    assert got == brute([r.embedding for r in rows])


def test_distant_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(ej, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in np.eye(4)[i % 4] + rng.normal(size=4) * 0.05]) for i in range(512)]
    df = spark.createDataFrame([(i, 1, v) for i, v in rows], "rep long, size long, embedding array<double>")
    blocks = ej.blocks_of(df, 4, 0.447, 512).cache()
    n = blocks.count()
    assert ej.near_blocks(blocks.select("block", "part", "lo", "hi"), 0.447, 4, 8).count() < 0.6 * n * (n + 1) / 2


def test_empty(spark):
    assert ej.join(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
