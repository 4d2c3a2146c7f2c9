import random

from pyspark.sql import functions as F

from sugarmill.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = [("idiot", False), ("disgusting", False), ("scum", False), ("stupid", False), ("moronic", True)]
    a = toxicity.Automaton(terms)
    for _ in range(4000):
        term = rng.choice(terms)[0]
        w = list(term)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "x", "0", rng.choice(term)])
        w = "".join(w)
        whole = [t for t, p in terms if not p and distance(w, t) <= toxicity.allowed_edits(t, False)]
        begins = [t for t, p in terms if p and any(distance(w[:i], t) <= toxicity.allowed_edits(t, True) for i in range(len(w) + 1))]
        assert (a.match(w) is not None) == bool(whole or begins), w
        if w == term:
            assert a.match(w)[0] == toxicity.EXACT
    assert a.match("idi0t") == (toxicity.OBFUSCATED, 0) and a.match("idoit") is None and a.match("idiit") == (toxicity.FUZZY, 0)


def corpus():
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice("abcdef") for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["idiot", "disgusting,", "worthless."])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs + [(1000, None), (1001, ""), (None, "idiot"), (1002, "a perfect idi0t here"), (1002, 'they wrote " you idiot " again')], labels


def test_held_out_scores(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(1))
    lab = spark.createDataFrame(labels + [(2000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    assert {"idiot", "disgusting", "worthless"} <= {t for t, _ in model.terms}
    got = {(r.doc_id, r.text): r for r in toxicity.score(d, model).select("doc_id", "text", "toxicity.*").collect()}
    toxic = dict((i, t) for i, _, t in labels)
    for (i, text), r in got.items():
        assert 0 <= r.score <= 1
        if i in toxic:
            assert (r.score >= 0.3) == bool(toxic[i])
    assert got[1000, None].score < 0.3 and got[1001, ""].score < 0.3 and got[None, "idiot"].score >= 0.3
    assert got[1002, "a perfect idi0t here"].score >= 0.3
    quoted = got[1002, 'they wrote " you idiot " again']
    assert quoted.quoted == 1 and quoted.score < got[None, "idiot"].score
    kept = {r.doc_id for r in toxicity.keep(d, lab).collect()}
    assert 0 not in kept and 1 in kept and 1000 in kept


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(d, lab).terms == []
    assert toxicity.keep(d, lab).count() == 1
    assert toxicity.keep(d.limit(0), lab).collect() == []


def test_a_lexicon_has_as_many_terms_as_its_documents_need():
    """No cap on terms: 2,400 terms in two documents each are all picked."""
    by_doc = {k: [f"term{k // 2}"] for k in range(4800)}
    assert sorted(toxicity.cover(by_doc, {}, 2)) == sorted({t for x in by_doc.values() for t in x})


def test_cover_is_greedy():
    """Each pick is the best of all terms that still add a document, as by looking at all of them each time."""
    rng = random.Random(8)
    for _ in range(60):
        names = [f"w{k:02}"[: rng.choice([2, 3])] + rng.choice(["", "*"]) for k in range(40)]
        by_doc = {k: sorted({rng.choice(names) for _ in range(rng.randrange(6))}) for k in range(rng.choice([5, 60]))}
        clean, least = {t: rng.choice([0, 0, 0, 1, 4]) for t in names}, rng.choice([2, 3])
        has = {t: {k for k, x in by_doc.items() if t in x} for x in by_doc.values() for t in x}
        total, want = {t: len(x) for t, x in has.items()}, []
        while has:
            gain = {t: len(x) - toxicity.PENALTY * clean[t] for t, x in has.items()}
            order = lambda t: (not t.endswith("*"), len(t), t)
            t = max(has, key=lambda t: (gain[t], *order(t)))
            wide = [t for t in has if total[t] >= 5 * least and not clean[t]]
            if gain[t] < least and t not in wide:
                if not wide:
                    break
                t = max(wide, key=lambda t: (len(has[t]), total[t], *order(t)))
            want.append(t)
            done = has[t]
            has = {x: y - done for x, y in has.items() if y - done}
        assert toxicity.cover(by_doc, clean, least) == want


def test_terms_have_any_length(spark):
    """Words of three letters and of fifty become terms and are found."""
    rng, long = random.Random(6), "scoundrel" * 6
    text = lambda: " ".join(f"plain{rng.randrange(300)}" for _ in range(30))
    rows = [(i, text() + (" kyx" if i % 10 == 0 else f" {long}." if i % 10 == 1 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 < 2)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity.score for r in toxicity.score(docs, model).collect()}
    assert {i for i, s in got.items() if s >= 0.3} == {i for i in got if i % 10 < 2}
