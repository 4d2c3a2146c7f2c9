"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import cut

#: Links that a task contracts to a forest at once.
FOREST = 300_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task, replaced by links of each id to the smallest it reaches through them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x], x = top, p
        return top

    def flush() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 2 * FOREST:
            yield flush()
    yield flush()


def stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b) with a > b: neighbours of an id are linked to the smallest of them and it."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the (a, b) links. Null ends and loops are ignored.

    Each round first contracts the links in tasks of about ``FOREST`` each. Where that is one task its forest is the
    result; else a large and a small star follow, until nothing changes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b and a is not null and b is not null"))
    mark = None
    while True:
        tasks = max(1, -(-edges.count() // FOREST))
        edges = cut(edges.coalesce(tasks).mapInArrow(forest, "a long, b long"))
        if tasks == 1:
            break
        edges = cut(stars(stars(edges, large=True), large=False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
