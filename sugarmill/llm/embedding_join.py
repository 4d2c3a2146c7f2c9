"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least ``least`` are at most ``eps = sqrt(2 - 2 least)`` apart, also after projection
on any orthonormal directions. Vectors are ordered by their grid cells (side ``eps``) on the leading principal
directions and cut into blocks. Intervals of the sequence are joined recursively, from the whole to single blocks; pairs
of intervals whose boxes are further apart than ``eps`` are dropped with all that is in them. Pairs of blocks that are
left are compared with one matrix product each, and what it finds is checked in double precision.

Equal vectors are one class. A block pair hands on link counts per class and a forest of its links, not all pairs, so
its output grows with the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sugarmill.llm.common import written
from sugarmill.llm.components import components
from sugarmill.llm.ngram_join import spanning

LEAST = 0.9
#: Vectors in a block; blocks in an interval; principal directions of the grid and the boxes.
BLOCK, FAN, DIRECTIONS = 2048, 8, 6


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The rows of a list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small components in range
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(classes: DataFrame, dim: int, k: int) -> np.ndarray:
    """The leading principal directions of all unit vectors of one length."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(0), dim))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    sums = classes.select("embedding").mapInArrow(products, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(dim * dim)
    for r in sums:  # dim * dim numbers
        total[r["at"]] = r.s
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1][:, :k].copy()


def blocks_of(classes: DataFrame, dim: int, eps: float, n: int) -> DataFrame:
    """(block, part, ids, sizes, vectors, lo, hi): the classes in grid order, in blocks; ids, sizes and vectors as bytes."""
    k = min(DIRECTIONS, dim)
    axes = directions(classes, dim, k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = unit(matrix(batch.column(2), dim)) @ axes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(p), pa.list_(pa.float64()))], names=["rep", "size", "embedding", "p"])

    placed = classes.select("rep", "size", "embedding").mapInArrow(project, "rep long, size long, embedding array<double>, p array<double>")
    cells = [F.floor(F.col("p")[i] / F.lit(eps)).alias(f"g{i}") for i in range(k)]
    order = [f"g{i}" for i in range(k)] + ["p0", "rep"]
    rows = placed.select("*", *cells, F.col("p")[0].alias("p0")).repartitionByRange(max(1, n // (4 * BLOCK)), *order).sortWithinPartitions(*order)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, rows_held = TaskContext.get().partitionId(), 0, [], 0

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            p = matrix(t.column("p").chunk(0), k)
            values = [(part << 32) + number, part, np.asarray(t.column("rep")).tobytes(), np.asarray(t.column("size")).tobytes(), matrix(t.column("embedding").chunk(0), dim).tobytes(), p.min(axis=0).tolist(), p.max(axis=0).tolist()]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=["block", "part", "ids", "sizes", "vectors", "lo", "hi"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                held.append(piece)
                rows_held += piece.num_rows
                while rows_held >= BLOCK:
                    t = pa.Table.from_batches(held)
                    yield block(t.slice(0, BLOCK))
                    number += 1
                    held, rows_held = t.slice(BLOCK).to_batches(), rows_held - BLOCK
        if rows_held:
            yield block(pa.Table.from_batches(held))

    return rows.select("rep", "size", "embedding", "p").mapInArrow(cut_up, "block long, part long, ids binary, sizes binary, vectors binary, lo array<double>, hi array<double>")


def near(eps: float, k: int):
    """Whether two boxes are at most ``eps`` apart."""
    gaps = [F.greatest(F.lit(0.0), F.col("lo2")[i] - F.col("hi1")[i], F.col("lo1")[i] - F.col("hi2")[i]) for i in range(k)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= F.lit(eps * eps + 1e-9)


def near_blocks(boxes: DataFrame, eps: float, k: int, parts: int) -> DataFrame:
    """(a, b) blocks, a <= b, that may hold a link: intervals of the sequence joined recursively."""
    levels = [boxes.select(F.col("block").alias("node"), F.col("part").alias("up"), "lo", "hi")]
    span = 1
    while True:
        below = levels[-1]
        box = below.groupBy("up").agg(*(F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(k)), *(F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(k)))
        up = F.floor(F.col("up") / FAN).cast("long") if span < parts else F.lit(-1).cast("long")
        levels.append(box.select(F.col("up").alias("node"), up.alias("up"), F.array(*(f"l{i}" for i in range(k))).alias("lo"), F.array(*(f"h{i}" for i in range(k))).alias("hi")))
        if span >= parts:
            break
        span *= FAN
    pairs = levels[-1].select(F.col("up").alias("a"), F.col("up").alias("b")).distinct()
    for level in reversed(levels):
        one = level.select(F.col("node").alias("n1"), F.col("up").alias("a"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        two = level.select(F.col("node").alias("n2"), F.col("up").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = pairs.join(one, "a").join(two, "b").filter((F.col("n1") <= F.col("n2")) & near(eps, k)).select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    return pairs


def compared(batches: Iterator[pa.RecordBatch], dim: int, least: float) -> Iterator[pa.RecordBatch]:
    """For (a, b, ids, sizes, vectors of both) rows: (id, to, n), the links' count per class and a forest of them."""
    for batch in batches:
        for r in range(batch.num_rows):
            a, b, ia, sa, va, ib, sb, vb = (batch.column(c)[r].as_py() for c in range(8))
            ia, ib, sa, sb = (np.frombuffer(x, np.int64) for x in (ia, ib, sa, sb))
            x = unit(np.frombuffer(va, np.float64).reshape(-1, dim))
            y = x if a == b else unit(np.frombuffer(vb, np.float64).reshape(-1, dim))
            x4, y4 = x.astype(np.float32), y.astype(np.float32)
            na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
            base = 0 if a == b else len(ia)
            links_i, links_j = [], []
            for at in range(0, len(x), 512):
                i, j = np.nonzero(x4[at : at + 512] @ y4.T >= np.float32(least - 1e-4))
                i = i + at
                if a == b:
                    i, j = i[i < j], j[i < j]
                for lo in range(0, len(i), 65536):  # exact products of few pairs at a time
                    p, q = i[lo : lo + 65536], j[lo : lo + 65536]
                    good = np.einsum("ij,ij->i", x[p], y[q]) >= least
                    p, q = p[good], q[good]
                    np.add.at(na, p, sb[q])
                    np.add.at(nb, q, sa[p])
                    links_i.append(p)
                    links_j.append(q + base)
            ids = ia if a == b else np.concatenate([ia, ib])
            n = na + nb if a == b else np.concatenate([na, nb])
            if links_i and n.any():
                to = ids[spanning(np.concatenate(links_i), np.concatenate(links_j), len(ids))]
                has = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(to[has]), pa.array(n[has])], names=["id", "to", "n"])


def join(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs with a cosine of at least ``least``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Repeated vectors link with each other; repeated rows come out each. An empty table gives none.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("good", good)
    classes = written(rows.filter("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    eps = sqrt(2 - 2 * least)
    found = None
    for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect():
        dim, k = r.dim, min(DIRECTIONS, r.dim)
        blocks = written(blocks_of(classes.filter(F.size("embedding") == dim), dim, eps, r.n))
        pairs = near_blocks(blocks.select("block", "part", "lo", "hi"), eps, k, max(1, r.n // (4 * BLOCK)))
        one = blocks.select(F.col("block").alias("a"), F.col("ids").alias("ia"), F.col("sizes").alias("sa"), F.col("vectors").alias("va"))
        two = blocks.select(F.col("block").alias("b"), F.col("ids").alias("ib"), F.col("sizes").alias("sb"), F.col("vectors").alias("vb"))
        spread = pairs.repartition(max(1, min(2000, (r.n // BLOCK) ** 2 // 16)), "a", "b")
        links = spread.join(one, "a").join(two, "b").select("a", "b", "ia", "sa", "va", "ib", "sb", "vb").mapInArrow(lambda x, d=dim: compared(x, d, least), "id long, to long, n long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "cid")
    named = classes.join(counts, classes.rep == counts.id, "left").join(comp, classes.rep == comp.cid, "left").select("embedding", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.filter("good").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
