"""Shards along a Hilbert curve.

Metadata dimensions are quantised to cells of about equal row counts: a value's cell is the number of cell borders at or below
it, and the borders are chosen from the counts of all distinct values, so any type that can be ordered may be a dimension. The cells'
index on a Hilbert curve orders the rows, with equal texts next to each other, and the order is cut into runs: shards. A shard
then holds a small box of cells, so its bounds in every dimension are narrow and a filter on any of them skips most files.

Order and places come from one exchange by range and the sums of its partitions. What comes to the driver are the borders (fewer
than ``2 ** bits`` values a dimension) and two numbers for each partition.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.llm.common import written

SHARDS, BITS = 24, 6
DIMENSIONS = ("lang", "source", "n_chars")
LAWS = ("rows", "bytes")


@cache
def curve(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of a Hilbert curve in ``n`` dimensions for each state and octant, at state * 2 ** n + octant.

    A state is where the curve enters a cube and along which axis it leaves it; its octants are walked in Gray code order
    seen from there.
    """
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & (size - 1)
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
    enter = lambda w: gray[2 * ((w - 1) // 2)] if w else 0
    along = lambda w: 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
    digits, nexts = [], []
    for state in range(n * size):
        entry, axis = state % size, state // size
        for octant in range(size):
            w = rank[turn(octant ^ entry, n - (axis + 1) % n)]
            digits.append(w)
            nexts.append((axis + along(w) + 1) % n * size + (entry ^ turn(enter(w), axis + 1)))
    return digits, nexts


def hilbert(cells: list[Column], bits: int) -> Column:
    """The index on the curve of a point whose coordinates have ``bits`` bits each."""
    n = len(cells)
    digits, nexts = (F.lit(x) for x in curve(n))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(acc: Column, bit: Column) -> Column:
        octant = sum((F.getbit(c.cast("long"), bit).cast("int") * F.lit(1 << k) for k, c in enumerate(cells)), F.lit(0))
        at = acc["state"] * F.lit(1 << n) + octant
        return F.struct(F.get(nexts, at).alias("state"), (acc["index"] * F.lit(1 << n) + F.get(digits, at)).alias("index"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


def ordered(df: DataFrame, by: list[Column]) -> DataFrame:
    """``df`` in the order of ``by``, dealt by range and written, with its partition ``part`` and place ``at`` there."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return written(rows.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}))


def earlier(weight: str) -> Column:
    """The sum of a weight over the rows of the same partition that come before this one."""
    return F.sum(weight).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight)


def before(rows: DataFrame, *weights: str) -> DataFrame:
    """(part, sum of each weight in the partitions before it as ``<weight>_before``, total as ``<weight>_total``); a row a partition."""
    sums = rows.groupBy("part").agg(*(F.sum(w).alias(w) for w in weights)).collect()  # a row for each partition
    sums.sort(key=lambda r: r["part"])
    out, at = [], [0] * len(weights)
    for r in sums:
        out.append([r["part"], *at])
        at = [a + r[w] for a, w in zip(at, weights, strict=True)]
    out = [(*row, *at) for row in out]
    names = [f"{w}_before long" for w in weights] + [f"{w}_total long" for w in weights]
    return rows.sparkSession.createDataFrame(out, "part long, " + ", ".join(names))


def borders(df: DataFrame, dimension: str, bits: int) -> list:
    """The lowest value of each cell but the first, so that cells have about equal row counts; null counts as lowest value."""
    counts = df.select(F.col(dimension).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    placed = ordered(counts, [F.col("value").asc_nulls_first()])
    inside = earlier("n")
    # a value lies in the cell of its middle row
    cell = F.expr(f"int((2 * (inside + n_before) + n) * {1 << bits} div (2 * n_total))")
    cells = placed.withColumn("inside", inside).join(F.broadcast(before(placed, "n")), "part").groupBy(cell.alias("cell")).agg(F.min("value").alias("low")).filter("low is not null")
    return [r["low"] for r in cells.orderBy("cell").collect() if r["cell"] > 0]


def cell(value: Column, low: list, kind: str) -> Column:
    """How many cell borders lie at or below a value; 0 for null."""
    if not low:
        return F.lit(0)
    return F.when(value.isNull(), 0).otherwise(F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in low)), lambda x: x <= value)))


def place(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, law: str = "rows", bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, curve, the dimensions, shard, slot) of every row.

    Law ``rows``: shards differ by at most one row. Law ``bytes``: a shard's bytes differ from the mean by at most the largest
    row. A row counts its text's UTF-8 bytes plus 8. ``slot`` numbers the rows of a shard from 0 without gaps, along the curve.

    Null texts count as empty, null values lie in the first cell, null ids stay null; repeated rows are placed each and ties in
    all of order are as they stand in the input. An empty table gives none. Only the named columns are read; a dimension
    with the name of a result column gets an underscore after it.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    text = F.col(text_col).cast("string")
    low = {d: borders(docs, d, bits) for d in dimensions}
    kinds = dict(docs.dtypes)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), hilbert([cell(F.col(d), low[d], kinds[d]) for d in dimensions], bits).alias("curve"), *(F.col(d).alias(f"d{k}") for k, d in enumerate(dimensions)),
        F.monotonically_increasing_id().alias("stood"),
    )
    one = F.lit(1).cast("long")
    placed = ordered(rows, [F.col(c) for c in ("curve", "text_hash", "doc_id", "stood")]).withColumn("one", one)
    if law == "rows":
        offsets = before(placed, "one")
        rank = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("at") + F.col("one_before"))
        out = rank.withColumn("shard", F.expr(f"int((rank * {shards}) div one_total)"))
        out = out.withColumn("slot", F.expr(f"rank - (shard * one_total + {shards - 1}) div {shards}"))
    else:
        inside = earlier("size")
        sums = placed.withColumn("inside", inside).join(F.broadcast(before(placed, "size", "one")), "part").withColumn("rank", F.col("at") + F.col("one_before"))
        out = sums.withColumn("shard", F.expr(f"int((2 * (inside + size_before) + size) * {shards} div (2 * size_total))"))
        first = out.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
        out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    named = [F.col(f"d{k}").alias(d if d not in ("doc_id", "size", "text_crc32", "curve", "shard", "slot") else f"{d}_") for k, d in enumerate(dimensions)]
    return out.select("doc_id", "size", "text_crc32", "curve", *named, "shard", "slot")


def bounds(placed: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(shard, n, bytes, low and high of each dimension, whether it holds null): what a reader needs to skip files."""
    each = [a for d in dimensions for a in (F.min(d).alias(f"{d}_low"), F.max(d).alias(f"{d}_high"), F.bool_or(F.col(d).isNull()).alias(f"{d}_null"))]
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *each)


def may_hold(limits: DataFrame, dimension: str, low, high) -> DataFrame:
    """The shards of ``bounds`` that may hold a row with ``low <= dimension <= high``."""
    return limits.filter((F.col(f"{dimension}_low") <= F.lit(high)) & (F.col(f"{dimension}_high") >= F.lit(low)))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as Parquet, a folder a shard, in curve order inside it. Ids must be unique and not null."""
    spots = placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    rows = docs.drop("shard", "slot").join(spots, id_col)
    # slots in pieces, so that a shard is not one task
    rows.repartition("shard", F.shiftright("slot", 17)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
