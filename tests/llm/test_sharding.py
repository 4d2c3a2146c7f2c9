import itertools
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.llm import sharding

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_all_cells_in_single_steps(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    rows = spark.createDataFrame(points, ", ".join(f"c{k} int" for k in range(n)))
    found = {r["i"]: tuple(r)[:n] for r in rows.withColumn("i", sharding.hilbert([F.col(f"c{k}") for k in range(n)], bits)).collect()}
    assert sorted(found) == list(range(len(points)))
    for i in range(1, len(points)):
        assert sum(abs(a - b) for a, b in zip(found[i - 1], found[i], strict=True)) == 1


def check(rows, law, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    if law == "rows":
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    else:
        total, most = sum(r.size for r in rows), max(r.size for r in rows)
        for s in range(shards):
            assert abs(sum(r.size for r in by[s]) - total / shards) <= most
    curve = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)


@pytest.mark.parametrize("law", sharding.LAWS)
def test_given_documents(spark, law):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = sharding.place(docs, law=law).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    check(rows, law, 24)


@pytest.mark.parametrize("law", sharding.LAWS)
def test_odd_rows(spark, law):
    long = "wort " * 200_000
    rows = [(1, None, None, None, None), (2, "", "de", "", 0), (2, "", "de", "", 0), (None, "ä", "de", "x", 1), (3, long, "de", "x", len(long))] + [(k, "same", "en", "hot", 4) for k in range(10, 60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("x")).withColumn("curve", F.lit(1))
    out = sharding.place(df, law=law, shards=5).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    check(out, law, 5)
    assert sharding.place(spark.createDataFrame([], SCHEMA), law=law).count() == 0
    assert len(sharding.place(df.limit(3), law=law).collect()) == 3


def test_repeats_lie_together(spark):
    rows = [(k, f"text {k % 7}", "en", "a", 6) for k in range(70)]
    out = sorted(sharding.place(spark.createDataFrame(rows, SCHEMA), shards=3).collect(), key=lambda r: (r.shard, r.slot))
    assert sum(a.text_crc32 != b.text_crc32 for a, b in itertools.pairwise(out)) == 6


def test_filters_skip_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    placed = sharding.place(docs).cache()
    in_order = docs.withColumn("shard", (F.percent_rank().over(Window.orderBy("doc_id")) * 23.99).cast("int")).withColumn("size", F.lit(1))
    asked = [("lang", x, x) for x in ("de", "en", "es", "fr")] + [("n_chars", 0, 300), ("n_chars", 300, 900), ("n_chars", 3000, 10**9)]
    touched = []
    for rows in (placed, in_order):
        limits = sharding.bounds(rows).cache()
        touched.append([sharding.may_hold(limits, *q).count() for q in asked])
    assert sum(touched[0]) < 0.85 * sum(touched[1]), touched
    assert sum(touched[0][4:]) < 0.6 * sum(touched[1][4:]), touched
    sharding.write_shards(docs, placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count()
    own = duckdb.connect().execute(f"select doc_id, shard from read_parquet('{tmp_path}/out/*/*.parquet', hive_partitioning = true)").fetchall()
    assert dict(own) == {r.doc_id: r.shard for r in placed.collect()}


def test_unknown_law(spark):
    with pytest.raises(ValueError):
        sharding.place(spark.createDataFrame([], SCHEMA), law="weight")
