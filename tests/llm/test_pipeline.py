import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sugarmill.llm import quality
from tests.llm.test_ngram_join import brute_sets, roots
from tests.llm.test_quality import brute_kept, brute_model


def corpus():
    """Clean documents, toxic ones, short ones, repetitive ones, near copies and shared passages."""
    rng = random.Random(5)
    vocab = [a + b + c for a in "ka re to mi su lo na".split() for b in "ra ve ti mo".split() for c in "n s l x".split()]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    docs, toxic = [], set()
    for i in range(140):
        t = "\n".join(text(40) for _ in range(2))
        if i % 7 == 0:
            t = t.replace(" ", " worthless ", 1)
            toxic.add(i)
        if i % 11 == 3:
            t += "\n" + passage
        docs.append((i, t, "en", "s", len(t)))
    docs.append((200, "too short", "en", "s", 9))
    docs.append((201, text(5) + " " + "again and again " * 60, "en", "s", 1))
    copy = docs[1][1].split(" ")
    copy[5] = "changed"
    docs.append((202, " ".join(copy), "en", "s", 1))
    docs.append((203, passage, "en", "s", 1))
    docs.append((204, None, None, None, None))
    return docs, toxic


def test_pipeline_matches_plain_python(spark, tmp_path):
    docs, toxic = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = rows.columns
        rows = corpus_pipeline.written(stage(spark, rows, str(tmp_path)))
        assert rows.columns == columns
        seen[name] = {r.doc_id: r.text for r in rows.collect()}
    texts = {r[0]: r[1] for r in docs}
    left = {i: t for i, t in texts.items() if i not in toxic}
    assert seen["toxicity"] == left

    def passes(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    rows = [(i, left[i], "en") for i in sorted(left) if passes(left[i])]
    prob = brute_model([(i, t, "en" if t is not None else None) for i, t in left.items()], quality.MIN_WORD, quality.MIN_PAIR)
    measures = []
    for _, t, _ in rows:
        w = t.split()
        p = [prob("en", a, b) for a, b in zip(["<begin>", *w], w)]
        ppl, low = (-sum(math.log(x[k]) for x in p) / len(w) for k in (0, 1))
        signs = sum(not any(c.isalnum() for c in x) for x in w)
        measures.append(("en", SimpleNamespace(n_words=len(w), n_repeat_words=0, n_sign_words=signs, log_ppl=ppl, log_low=low)))
    left = {r[0]: r[1] for r in brute_kept(rows, measures)}
    assert seen["quality_rules"] == left
    ids = sorted(left)
    sets = [brute_sets(left[i], 5) for i in ids]
    r = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    left = {i: left[i] for k, i in enumerate(ids) if r[k] == k}
    assert seen["ngram_join"] == left and 202 not in left
    units = [(i, k, line) for i in sorted(left) for k, line in enumerate(left[i].split("\n")) if len(line.split()) >= 25]
    sets = [brute_sets(u[2], 5) for u in units]
    r = roots(len(units), [(a, b) for a in range(len(units)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    gone = {u[:2] for k, u in enumerate(units) if r[k] != k}
    left = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in left.items()}
    left = {i: t for i, t in left.items() if t.strip()}
    assert seen["substring_dedup"] == left and gone and 203 not in left
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
