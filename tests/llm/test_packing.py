import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sugarmill.llm import packing

TEXTS = [
    (1, "the cat sat on the mat"), (2, None), (3, ""), (4, "a  b\n c "), (5, " lead"), (6, "x" * 5000), (7, "word " * 3000 + "end"),
    (8, "<|endoftext|> ok"), (9, "the cat sat on the mat"), (None, "no id"), (10, "tab\tin it  wide"), (11, "é\nü"), (9, "twice"),
]


def whole(spark, rows, window=1024):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", packing.F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(df.repartition(2), path, window=window).collect()


def test_every_id_once_and_no_padding(spark):
    rows = TEXTS + [(100 + i, "some words of a text " * (i % 37)) for i in range(300)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = whole(spark, rows)
    by_seq, tokens = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length * 4 == len(r.ids) and r.length > 0
        by_seq[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        joined = b"".join(b for _, b in sorted(tokens[doc, len(ids)]))
        assert joined == np.array(ids, "<u4").tobytes() or [d for d, _ in rows].count(doc) > 1
    assert zlib.crc32(got[0].ids) == spark.createDataFrame([(got[0].ids,)], "b binary").select(packing.ids_crc32(packing.F.col("b"))).first()[0]


def test_level_choice_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    levels = packing.Levels(16)
    for i in range(400):
        size, before = int(rng.integers(1, 17)), levels.counts.copy()
        best = []
        for h in range(0, 17 - size):
            if h == 0 or before[h]:
                n = before.copy()
                n[h] -= h > 0
                n[h + size] += h + size < 16
                best.append(int((n[1:16] ** 2).sum()))
        levels.place((i, 0, b"", 0), size)
        assert int((levels.counts[1:16] ** 2).sum()) == min(best)


def test_empty_table(spark):
    assert whole(spark, []) == []


def test_a_cache_goes_with_its_task(spark):
    """The pipeline's workers go on with other stages, so they do not keep tokens; the pieces are the same."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [sorted(map(str, packing.pack(df, path, cache_words=k, outlives=stays).collect())) for k, stays in ((777, False), (778, True))]
    assert got[0] == got[1]
    kept = spark.sparkContext.parallelize(range(8), 8).flatMap(lambda _: [k for _, k in packing._CACHES]).collect()
    assert 777 not in kept
