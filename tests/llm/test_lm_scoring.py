import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sugarmill.llm import lm_scoring as lm


def split(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def corpus():
    rng = random.Random(3)
    names = "the of and cat dog sat ran hill mat red big".split()
    texts = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(2, 40)):
            words += rng.choice([["the", rng.choice(names)], ["of", "the", "hill"], [f"Rare{rng.randrange(80)}"], ["big", "red"]])
        texts.append(" ".join(words))
    return list(enumerate(texts + [None, "", " unseenword THE \n of"])) + [(None, "the cat")]


def brute(train, strength):
    """Probability of a token after another one, from dictionaries."""
    seqs = [split(t) for t in train]
    c1, c2 = Counter(w for s in seqs for w in s), Counter()
    for s in seqs:
        c2.update(zip(["\n", *s], s))
    n, v = sum(c1.values()), len(c1)
    once, twice = (sum(c == k for c in c1.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5

    def p(x, w):
        own = (c1[w] - d) / n if c1[w] else max(d * v, 1) / n
        return (c2[x, w] + strength * own) / (c1[x] + strength)

    return p, c1, n, v


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 700)
    rows = corpus()
    rows += [rows[5], rows[5]]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("Key", F.lit(1)).repartition(3)
    p, c1, n, v = brute([t for i, t in rows if i is not None and not out(i)], lm.STRENGTH)
    got = [r for r in lm.score_corpus(docs).collect()]
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    text, better = dict(rows), 0.0
    for r in got:
        s = ["\n", *split(text[r.doc_id])]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out(r.doc_id), len(s) - 1, n)
        assert r.n_known == sum(c1[w] > 0 for w in s[1:])
        assert abs(r.base_score - sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s[1:])) < 1e-9
        want = sum(math.log10(p(x, w)) for x, w in zip(s, s[1:]))
        assert abs(r.score - want) < 1e-8, (r.doc_id, r.score, want)
        better += (r.score - r.base_score) * r.held_out
    assert better > 0
    names = {*c1, "unseen"}
    for x in ("\n", "of", "the", "big", "neverseen"):
        assert abs(sum(p(x, w) for w in names) - 1) < 1e-6


def test_long_text(spark):
    long = " ".join(f"w{k % 997}" for k in range(200_000))
    got = {r.doc_id: r for r in lm.score_corpus(spark.createDataFrame([(0, long), (1, long), (2, "w1 w2")], "doc_id long, text string")).collect()}
    assert got[0].n_tokens == 200_001 and got[0].score == got[1].score and got[0].score > got[0].base_score


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_corpus(docs).collect() == []
    one = spark.createDataFrame([(i, "a") for i in range(1)], "doc_id long, text string")
    assert lm.score_corpus(one).count() == 1
