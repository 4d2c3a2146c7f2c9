from collections import Counter

import numpy as np
import public_tokenizers

from pyspark.sql import functions as F
from sugarmill.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["the cat sat", "", None, " a  b\n\nc \n", "▁x▁ y", "日本語 𝄞\t\r\u0000", "x" * 500, "word " * 400, "\n", " ", "<s></s><0x0A>", "Éauouon naïve"]


def test_round_trip_and_reproducible(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (0, "the cat sat")], "doc_id long, text string").withColumn("ids", F.lit(1))
    for best in (False, True):
        one = pieces.encode(df, MODEL, best=best).withColumn("back", pieces.decode(F.col("ids"), MODEL)).collect()
        assert all(r.back == (r.text or "") for r in one) and len(one) == df.count()
        two = {(r.doc_id, r.text): r.ids for r in pieces.encode(df.repartition(3), MODEL, best=best).collect()}
        assert all(two[r.doc_id, r.text] == r.ids for r in one)
    assert pieces.encode(df.limit(0), MODEL).collect() == []


def paths(v, unit):
    """All segmentations of a unit with their weights."""
    if not unit:
        return [((), 1.0)]
    out = []
    for n in range(1, min(len(unit), v.longest) + 1):
        p = v.weight.get(unit[:n])
        if p:
            out += [((p[0], *rest), p[1] * w) for rest, w in paths(v, unit[n:])]
    return out


def test_samples_follow_the_path_weights():
    v = pieces.Vocabulary(MODEL, 0.5)
    all_paths = dict(paths(v, " there"))
    total = sum(all_paths.values())
    lattices = pieces.Lattices(v, False)
    n = 20000
    got = Counter(tuple(np.frombuffer(x, "<u4").tolist()) for x in pieces.encode_rows(lattices, pieces.row_keys(list(range(n)), 0), ["there"] * n))
    assert set(got) <= set(all_paths)
    for p, w in all_paths.items():
        assert abs(got[p] / n - w / total) < 0.015
    best = pieces.encode_rows(pieces.Lattices(v, True), [0], ["there"])[0]
    assert tuple(np.frombuffer(best, "<u4").tolist()) == max(all_paths, key=all_paths.get)


def test_runs_of_spaces_and_long_units_have_their_lattice():
    v = pieces.Vocabulary(MODEL, 0.5)
    all_paths = dict(paths(v, "    there"))
    assert any(v.raw[k] == b"  " for p in all_paths for k in p)
    total, n = sum(all_paths.values()), 20000
    got = Counter(tuple(np.frombuffer(x, "<u4").tolist()) for x in pieces.encode_rows(pieces.Lattices(v, False), pieces.row_keys(list(range(n)), 0), ["   there"] * n))
    assert set(got) <= set(all_paths) and max(abs(got[p] / n - w / total) for p, w in all_paths.items()) < 0.015
    text = "there" * 3000
    for best in (False, True):
        ids = np.frombuffer(pieces.encode_rows(pieces.Lattices(v, best), [1], [text])[0], "<u4")
        assert b"".join(v.raw[k] for k in ids).decode() == " " + text and len(ids) < 12_000
