import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sugarmill.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
SMALL = {i: i + 32 for i in range(65, 91)}


def brute(rows, support=10, share=50, best=2000):
    f = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(SMALL)):
            w = re.findall("[^ \t]+", piece)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = Counter()
    for k, c in f.items():
        if len(k) == 2:
            n[k[0]] += c
    candidates = {k: c for k, c in f.items() if len(k) > 2 and c >= support}
    out = {}
    for k, a in candidates.items():
        if len(k) == 3 and any(100 * b >= share * a for j, b in candidates.items() if len(j) == 4 and j[0] == k[0] and k[1:] in (j[1:3], j[2:4])):
            continue
        s, _, left, right = min((1_000_000 * a * a // (f[k[:c]] * f[(k[0], *k[c:])]), c, f[k[:c]], f[(k[0], *k[c:])]) for c in range(2, len(k)))
        out.setdefault(k[0], []).append((-s, -a, " ".join(k[1:]).encode(), left, right))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)}


def same(df, want):
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}
    assert got == want


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "new york", "new York city", "c", "É", "d-d", "x\tx"]
    ends = [" ", " ", "  ", ", ", ".", "\n", "\x0b", "\t"]
    text = lambda: "".join(words[i] + ends[j] for i, j in zip(rng.integers(0, 8, 30), rng.integers(0, 8, 30), strict=True))
    return [(k, text(), [None, "en", "de"][k % 3]) for k in range(n)]


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_equals_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE", 100)
    rows = random_rows(1, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    same(phrases.mine(df, shards=shards), brute(rows))
    same(phrases.mine(df, shards=shards, support=3, share=90, best=20), brute(rows, 3, 90, 20))


def test_odd_rows(spark):
    long = "one two three " * 5000 + ". " + "z" * 100_000
    rows = [(1, None, "en"), (2, "", None), (2, " \t\n", None), (None, long, "en"), (3, long, None), (3, long, None), (4, "a b", "x"), (5, ".,;:!?", "x"), (6, "\x00 \x1c \xa0 " * 12, "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))
    same(phrases.mine(df), brute(rows))
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0


def test_ties_are_ordered_by_bytes(spark):
    rows = [(k, f"{a} {b}.", "en") for k in range(12) for a, b in (("é", "z"), ("z", "é"), ("a", "ü"), ("\U0001f600", "b"), ("ﬀ", "b1"))]
    same(phrases.mine(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_texts_cut_in_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", 40)
    rows = random_rows(2, 30)
    found = [p for _, t, _ in rows for p in phrases.chunks(t.encode().translate(phrases.SEPARATORS))]
    assert len(found) > len(rows)
    assert b"".join(found) == b"".join(t.encode().translate(phrases.SEPARATORS) for _, t, _ in rows)
    same(phrases.mine(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_shards_prune_but_lose_nothing():
    """A hash below its shard's support is out of that shard's filter; one that reaches it in any shard is in."""
    keys = np.array([5, 9], np.uint64) << np.uint64(60)
    said = [phrases.stated(keys, np.array([3, 2]), 0, 3, 0), phrases.stated(keys, np.array([1, 2]), 1, 4, 0), phrases.stated(keys, np.array([1, 2]), 1, 4, 0)]
    out = phrases.frequent(pa.Table.from_batches(said), 0).to_pylist()
    bits = [np.frombuffer(pa.decompress(r["bits"], 1 << (phrases.FILTER_BITS - 3), codec="zstd", asbytes=True), np.uint8) for r in out]
    assert [r["n"] for r in out] == [1, 1]
    assert phrases.passes(keys, bits[0]).tolist() == [True, False] and phrases.passes(keys, bits[1]).tolist() == [False, True]


def test_spark_keeps_wide_products(spark):
    rows = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_000), (10**15, 10**15, 10**15)], "a long, l long, r long")
    assert [r[0] for r in rows.select(F.expr(phrases.score("a", "l", "r"))).collect()] == [450000, 1_000_000]
