import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sugarmill.llm import ngram_join as nj
from sugarmill.llm.components import components


def brute_sets(text, n):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def corpus(seed):
    rng, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(400)]
    for _ in range(40):
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200, 600]))
        out.append(base)
        for _ in range(rng.randrange(5)):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 18 + 1)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choices(vocab, k=rng.randrange(2))
                t = t or ["x"]
            out.append(t)
    texts = [" ".join(t) for t in out] + [None, "", " \n", out and " ".join(out[0]).upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_matches_brute_force(spark, n, percent, seed):
    texts = corpus(seed)
    sets = [brute_sets(t, n) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(len(texts), pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("Component_id", F.lit("c"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.join(docs, n, percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = {r.doc_id for r in nj.keep_one(docs, n, percent).collect()}
    assert kept == {i for i in range(len(texts)) if want[i] == i}


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        percent = int(rng.choice([80, 85]))
        size = int(rng.integers(1, 400))
        a = rng.choice(1 << 40, size, replace=False).astype(np.uint64)
        worst = (100 - percent) * size // 100
        drop, add = int(rng.integers(0, worst + 1)), int(rng.integers(0, worst + 1))
        b = np.concatenate([a[drop:], rng.choice(1 << 40, add).astype(np.uint64) + np.uint64(1 << 41)])
        same = len(np.intersect1d(a, b))
        if 100 * same >= percent * (len(set(a.tolist()) | set(b.tolist()))):
            assert len(np.intersect1d(nj.signatures(np.unique(a), percent), nj.signatures(np.unique(b), percent)))


def test_sketches_never_miss():
    rng = np.random.default_rng(6)
    for _ in range(500):
        a = rng.choice(1 << 40, int(rng.integers(1, 900)), replace=False).astype(np.uint64)
        b = np.concatenate([a[int(rng.integers(0, len(a))) :], rng.choice(1 << 40, int(rng.integers(0, 90))).astype(np.uint64)])
        b = np.unique(b)
        x, y = nj.sketch(a), nj.sketch(b)
        width = min(len(x), len(y))
        apart = (int.from_bytes(nj.folded(x, width)) ^ int.from_bytes(nj.folded(y, width))).bit_count()
        assert apart <= len(np.setxor1d(a, b))
        assert len(b) and (nj.folded(x, 64) == nj.sketch(a) or len(x) > 64)


@pytest.mark.parametrize("limit", [300, 500_000])
def test_groups_that_pivots_do_not_decide(spark, monkeypatch, limit):
    monkeypatch.setattr(nj, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(nj, "SKETCH_BYTES", limit)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(70)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            t[rng.randrange(70)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(t))
    sets = [brute_sets(t, 4) for t in texts]
    pairs = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nj.join(docs).collect()} == dict(enumerate(roots(150, pairs)))


def test_large_group_and_empty_table(spark):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) if i else " ".join(base) for i in range(60)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in nj.join(docs).collect()} == {0}
    more = [(None, texts[0]), (7, texts[1]), (7, texts[1]), (900, " ".join(f"u{i}" for i in range(80_000))), (901, " ".join(f"u{i}" for i in range(80_001))), (None, "alone " * 9), (None, None)]
    rows = nj.join(spark.createDataFrame([*enumerate(texts), *more], "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert len(rows) == len(texts) + len(more) and {c for _, c in got[7]} == {0} and {c for _, c in got[900] | got[901]} == {900}
    assert got[None] == {(57, 0), (1, None), (0, None)}
    assert nj.join(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3)]
    want = roots(500, [p for p in pairs if p[0] is not None])
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert got == {i: want[i] for p in pairs if p[0] is not None for i in p if p[0] != p[1]} | {i: want[i] for i in got}
    assert all(i in got for p in pairs if p[0] is not None and p[0] != p[1] for i in p)
