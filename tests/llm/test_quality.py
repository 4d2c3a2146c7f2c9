import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sugarmill.llm import quality

ROWS = [(i, f"the cat sat on mat number {i % 7} and the dog ran over hill {i % 5} ", "en") for i in range(40)] + [
    (100, None, "en"), (101, "", None), (102, "der hund läuft\nder hund läuft\n \n", "de"), (103, "x|#$ " * 60, "en"), (103, "x|#$ " * 60, "en"), (None, "a b c a b c a", "de"),
]
SCHEMA = "doc_id long, text string, lang string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_model(rows, min_word, min_pair):
    """Interpolated modified Kneser-Ney over pairs of words, from dictionaries: a function giving p(b | a), with and without a."""
    share = Counter(lang or "" for _, text, lang in rows for _ in words_of(text))
    total = sum(share.values())
    name = lambda lang: lang if lang and share[lang] >= quality.MIN_LANG * total else ""
    known = len({name(x) for x in share} - {""}) + 1
    one, two = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        one[name(lang)].update(words_of(text))
    vocabulary = {k: {w for w, c in n.items() if c >= max(2, min_word * known * sum(n.values()))} for k, n in one.items()}
    coded = lambda k, w: w if w in vocabulary.get(k, ()) else "<unknown>"
    for _, text, lang in rows:
        k = name(lang)
        x = [coded(k, w) for w in words_of(text)]
        two[k].update(zip(["<begin>", *x], x))

    def off(counts):
        cc = Counter(counts)
        y = cc[1] / (cc[1] + 2 * cc[2]) if cc[1] else 0.5
        return [0] + [min(max(k - (k + 1) * y * cc[k + 1] / cc[k], 0.1 * k), 0.9 * k) if cc[k] else 0.5 * k for k in (1, 2, 3)]

    stats = {}
    for k in two:
        before, totals, kept = Counter(y for _, y in two[k]), Counter(), defaultdict(dict)
        for (x, _), c in two[k].items():
            totals[x] += c
        d1, d2 = off(before.values()), off(two[k].values())
        for (x, y), c in two[k].items():
            if c >= max(2, min_pair * known * sum(one[k].values())):
                kept[x][y] = (c - d2[min(c, 3)]) / totals[x]
        w1 = {x: (c - d1[min(c, 3)]) / sum(before.values()) for x, c in before.items()}
        rest = (1 - sum(w1.values())) / (len(before) + 1)
        stats[k] = totals, kept, {x: w + rest for x, w in w1.items()}

    def prob(lang, a, b):
        k = name(lang)
        totals, kept, single = stats[k]
        a, b = a if a == "<begin>" else coded(k, a), coded(k, b)
        alone = single.get(b, 1e-9)
        p = kept[a].get(b, 0) + (max(1 - sum(kept[a].values()), 1e-9) if totals[a] else 1) * alone
        shared = max(len(one[k]) - len(vocabulary.get(k, ())), 1) if b == "<unknown>" else 1
        return p / shared, alone / shared

    return prob


def test_model_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    model, prob = quality.fit(docs, min_word=0.002, min_pair=0.001), brute_model(ROWS, 0.002, 0.001)
    got = {(r.doc_id, r.lang, r.text): r.quality for r in quality.score(docs, model).collect()}
    for doc, text, lang in ROWS:
        words = words_of(text)
        m = got[doc, lang, text]
        if not words:
            assert m.log_ppl is None and m.log_low is None
            continue
        both = [prob(lang, a, b) for a, b in zip(["<begin>", *words], words)]
        assert m.n_sign_words == sum(not any(ch.isalnum() for ch in w) for w in words)
        for k, x in enumerate((m.log_ppl, m.log_low)):
            assert abs(x + sum(math.log(p[k]) for p in both) / len(words)) < 1e-9, (doc, k)
    names = {w for _, t, lang in ROWS if lang == "en" for w in words_of(t)}
    alone = {"<unknown>" if prob("en", "the", w)[1] < 1e-8 else w for w in names}
    assert abs(sum(prob("en", "the", w)[0] for w in alone) - 1) < 0.1


def brute_kept(rows, measures):
    """The verdict on (lang, measures) rows, with percentiles of distinct results by plain sorting."""
    passed = [m.n_words >= 50 and 100 * m.n_repeat_words <= 50 * m.n_words and 100 * m.n_sign_words <= quality.MOST_SIGNS * m.n_words for _, m in measures]
    at = lambda x, q: sorted(x)[max(math.ceil(q * len(x)) - 1, 0)]
    edges = {}
    for lang in {k for k, _ in measures}:
        own = {(m.n_words, round(m.log_ppl, 6), round(m.log_low, 6)) for (k, m), ok in zip(measures, passed) if ok and k == lang}
        if own:
            x, y = [o[1] for o in own], [o[2] for o in own]
            off = lambda v, distances: at(v, 0.5) + distances * (at(v, 0.75) - at(v, 0.5))
            edges[lang] = off(y, -quality.BELOW), off(x, quality.ABOVE), off(y, quality.ABOVE_ALONE)
    inside = lambda lang, m: edges[lang][0] <= round(m.log_low, 6) <= edges[lang][2] and round(m.log_ppl, 6) <= edges[lang][1]
    return [r for r, (lang, m), ok in zip(rows, measures, passed) if ok and inside(lang, m)]


def test_bands_match_brute_force(spark):
    rng = random.Random(4)
    names = ["the", "of", "and", *(f"w{i}" for i in range(60))]
    text = lambda: " ".join(rng.choice(names[: rng.choice([5, 60])]) for _ in range(rng.randrange(40, 120)))
    rows = [(i, text() if i % 9 else " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)), "en" if i % 3 else "de") for i in range(120)]
    rows += [(500 + i, rows[1][1], "en") for i in range(40)]  # copies
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.quality for r in quality.score(docs, quality.fit(docs)).collect()}
    measures = [(lang, got[i]) for i, _, lang in rows]
    want = {r[0] for r in brute_kept(rows, measures)}
    assert {r.doc_id for r in quality.keep(docs).collect()} == want
    assert not any(i % 9 == 0 for i in want if i < 500) and {i for i in want if i >= 500}


def test_counts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = quality.score(docs, quality.fit(docs)).select("doc_id", "text", "quality.*").collect()
    for r in got:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    assert len(got) == len(ROWS)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.keep(empty).collect() == []
    long = spark.createDataFrame([(1, "word and more of it " * 60_000, "en"), (2, None, "en")], SCHEMA)
    m = {r.doc_id: r.quality for r in quality.score(long, quality.fit(long)).collect()}
    assert m[1].n_words == 300_000 and m[1].n_repeat_words == 300_000 and m[2].n_words == 0
    odd = spark.createDataFrame(ROWS, SCHEMA).withColumn("row", F.lit(1)).withColumn("lower", F.lit(2)).withColumn("quality", F.lit(3))
    assert quality.keep(odd).columns == odd.columns
    both = quality.score(odd, quality.fit(odd))
    assert both.columns == [*odd.columns, "quality_"] and {r.quality for r in both.collect()} == {3}


def test_bands_and_signs_reject_planted_texts(spark):
    """Texts of the most frequent words alone, of unknown words, and with many signs, beside the given documents. Four copies of a text
    of unknown words are enough to make it look known in a small language now and then: in most languages they go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    rows, rng = docs.collect(), random.Random(9)
    common = {lang: [w for w, _ in Counter(w for r in rows if r.lang == lang for w in words_of(r.text)).most_common(14)] for lang in {r.lang for r in rows}}
    plants, kinds = [], {}
    for lang, names in sorted(common.items()):
        unknown = " ".join(f"q{rng.randrange(10**9)}" for _ in range(120))
        own = next(r.text for r in rows if r.lang == lang and len(words_of(r.text)) > 100)
        for kind, text in [("low", " ".join(rng.choice(names) for _ in range(90))), ("high", unknown), *[("copied", f"{unknown} {unknown[::-1]}")] * 4, ("signs", " ".join(w + " #" * (k % 10 == 0) for k, w in enumerate(words_of(own))))]:
            kinds[10**6 + len(plants)] = kind
            plants.append((10**6 + len(plants), lang, text))
    every = docs.unionByName(spark.createDataFrame(plants, "doc_id long, lang string, text string"))
    kept = {r.doc_id for r in quality.keep(every).select("doc_id").collect()}
    stay = Counter(kinds[i] for i in kept & set(kinds))
    assert set(stay) <= {"copied"} and stay["copied"] <= 4, stay
    clean = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1").collect()}
    passed = {r.doc_id for r in rows if r.doc_id in clean and len(words_of(r.text)) >= 50}
    assert len(passed - kept) <= 0.02 * len(passed)


def test_words_of_many_texts_are_hashed_at_once():
    """Equal words have equal hashes wherever they stand, different ones different hashes; the last bit is that of a letter or digit."""
    rng = random.Random(3)
    texts = [None, "", " \t ", "a", "ab_ _ __ # \x1c \x85x", "über ß — – 日本語 ٣ \ud800 z", " ".join("x" * k for k in range(1, 200)), "ÿ" * 100 + "\x0b\x0cq\r\n\n"]
    texts += [" ".join("".join(rng.choice("ab_-é") for _ in range(rng.randrange(1, 20))) for _ in range(50)) for _ in range(20)]
    h, n = quality.hashed(texts)
    words = [w for t in texts for w in words_of(t)]
    assert n.tolist() == [len(words_of(t)) for t in texts] and len(h) == len(words)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert [x & 1 for x in h.tolist()] == [any(ch.isalnum() for ch in w) for w in words]
    assert quality.hashed([])[0].tolist() == [] and quality.hashed(["b", texts[6]])[0][1:].tolist() == quality.hashed([texts[6]])[0].tolist()


def test_rare_words_and_pairs_are_looked_up(spark, monkeypatch):
    """All words and pairs that stand twice have weights of their own however many others there are, over several blocks and ranges;
    texts that the model is not made of are scored and count nothing."""
    monkeypatch.setattr(quality, "RANGE", 20_000, raising=False)
    rng = random.Random(5)
    text = lambda k: " ".join([*(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(1_000)), f"r{k // 2}", f"r{k // 2} s{k // 2}", f"once{k}"])
    rows = [(k, text(k), "en" if k % 4 else "de") for k in range(600)]
    others = [(1000, "w1 w2 r5 s5 new words w3", "en"), (1001, "new " + text(3), "de"), (1002, rows[1][1], "fr"), (1003, None, "en")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    model, prob = quality.fit(docs), brute_model(rows, 0, 0)
    assert len(model.bits()) == 3 and max(model.bits()) > 3
    got = {r.doc_id: r.quality for df in (docs, spark.createDataFrame(others, SCHEMA)) for r in quality.score(df, model).collect()}
    for doc, text, lang in rows + others[:2]:
        words = words_of(text)
        both = [prob(lang, a, b) for a, b in zip(["<begin>", *words], words)]
        for k, x in enumerate((got[doc].log_ppl, got[doc].log_low)):
            assert abs(x + sum(math.log(p[k]) for p in both) / len(words)) < 1e-9, (doc, k)
    assert got[1002].log_ppl is not None and got[1003].log_ppl is None and got[1003].n_words == 0
