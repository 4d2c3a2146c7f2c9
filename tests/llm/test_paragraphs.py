import random

from pyspark.sql import functions as F

from sugarmill.llm import paragraphs
from tests.llm.test_ngram_join import brute_sets, roots


def corpus():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    passages = [rng.choices(vocab, k=rng.choice([26, 40, 60, 120])) for _ in range(12)]
    docs = []
    for i in range(80):
        lines = [" ".join(rng.choices(vocab, k=rng.choice([3, 12, 30, 55]))) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = rng.choice(vocab)
            lines.insert(rng.randrange(len(lines) + 1), " ".join(p))
        docs.append((i, "\n".join(lines), 1))
    return docs + [(500, None, None), (501, "", 0), (502, "short line\nshort line", 20), (None, docs[0][1], 5), (503, " ".join(passages[0]) + "\n" + " ".join(passages[0]), 9)]


def test_matches_brute_force(spark):
    docs = corpus()
    units = [(i, k, brute_sets(line, 5)) for i, t, _ in docs if i is not None for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 25]
    pairs = [(a, b) for a in range(len(units)) for b in range(a) if 100 * len(units[a][2] & units[b][2]) >= 80 * len(units[a][2] | units[b][2])]
    r = roots(len(units), pairs)
    order = {root: min(units[k][:2] for k in range(len(units)) if r[k] == root) for root in set(r)}
    size = {root: r.count(root) for root in set(r)}
    want = {(i, k, *order[r[x]], (i, k) != order[r[x]]) for x, (i, k, _) in enumerate(units) if size[r[x]] > 1}
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").withColumn("gone", F.lit(1))
    got = {(x.doc_id, x.line, x.cluster_doc, x.cluster_line, x.removed) for x in paragraphs.clusters(df).collect()}
    assert got == want and any(x[4] for x in want)
    gone = {(i, k) for i, k, *_, removed in want if removed}
    texts = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None and i is not None else t for i, t, _ in docs}
    left = {x.doc_id: x for x in paragraphs.remove(df).collect()}
    for i, t, n in docs:
        if i is None or not any(d == i for d, _ in gone):
            assert left[i].text == t and left[i].n_chars == n and left[i].gone == 1
        elif texts[i].strip():
            assert left[i].text == texts[i] and left[i].n_chars == len(texts[i])
        else:
            assert i not in left
    assert paragraphs.clusters(df.limit(0)).collect() == []


def test_tuning():
    bands, rows = paragraphs.tuned(80)
    assert bands * rows <= 32 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_passages_inside_and_across_lines_go(spark):
    rng = random.Random(5)
    some = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    p, q, own = some(69), some(50), [some(70) for _ in range(6)]
    across = "\n".join(" ".join(p[k : k + 10]) for k in range(0, 69, 10))
    loop = " ".join(["la", "le", "lu"] * 40)
    docs = [
        (0, " ".join(own[0] + p + own[1])),
        (1, " ".join(own[2]) + "\n" + across.upper() + "\n" + " ".join(own[3][:20])),
        (2, " ".join(own[4] + q[:49] + ["x"])),
        (3, " ".join(own[5] + q)),
        (4, " ".join(q + own[3])),
        (5, loop),
        (None, " ".join(p)),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    want = {0: docs[0][1], 1: " ".join(own[2]) + "\n" + " ".join(own[3][:20]), 2: docs[2][1], 3: docs[3][1], 4: " ".join(own[3]), 5: " ".join((["la", "le", "lu"] * 40)[:50]), None: " ".join(p)}
    left = {x.doc_id: x for x in paragraphs.remove(df).collect()}
    assert {i: x.text for i, x in left.items()} == want
    assert all(x.n_chars == len(x.text) for x in left.values())
    spans = {(x.doc_id, x.start, x.n_words, x.kept_doc) for x in paragraphs.passages(df, paragraphs.gone_lines(paragraphs.clusters(df))).collect()}
    assert spans == {(1, 70, 69, 0), (4, 0, 50, 3), (5, 50, 70, 5)}
