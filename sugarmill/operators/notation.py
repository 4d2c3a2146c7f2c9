"""Linear sequences, structure names and ambiguous structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sugarmill.functions.lineage import cut


def linear(nodes: DataFrame) -> DataFrame:
    """(glycan_id, text) of rows (glycan_id, node, parent, depth, label, rank): children by rank, all but the first in brackets, then the node."""
    rows = cut(nodes.select("glycan_id", "node", "parent", "depth", "label", "rank"))
    below = None
    for k in range(rows.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = rows.filter(F.col("depth") == k)
        if below is not None:
            order = Window.partitionBy("glycan_id", "parent").orderBy("rank", "node")
            first = F.lag("node").over(order).isNull()
            kid = below.withColumn("t", F.when(first, F.col("text")).otherwise(F.concat(F.lit("("), "text", F.lit(")")))).withColumn("n", F.row_number().over(order))
            kids = kid.groupBy("glycan_id", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "").alias("kids"))
            level = level.join(kids, ["glycan_id", "node"], "left")
        else:
            level = level.withColumn("kids", F.lit(""))
        below = cut(level.select("glycan_id", "node", "parent", "rank", F.concat(F.coalesce("kids", F.lit("")), "label").alias("text")))
    return below.select("glycan_id", "text")


TOKEN = r"[()]|[A-Z]+[ab?][0-9?]?"


def linear_residues(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, parent, code, anomer, pos): tokens read from the right; ``)`` opens a branch at the last residue, ``(`` goes back to where it began."""
    tokens = F.reverse(F.expr(f"regexp_extract_all({text}, '{TOKEN}', 0)"))
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(-1).alias("last"), F.lit(0).alias("n"), F.array().cast("array<struct<place:int,parent:int,token:string>>").alias("out"))

    def step(a, t):
        node = F.struct(a["n"].alias("place"), F.when(a["last"] >= 0, a["last"]).alias("parent"), t.alias("token"))
        push = F.struct(F.concat(F.array(a["last"]), a["stack"]).alias("stack"), a["last"].alias("last"), a["n"].alias("n"), a["out"].alias("out"))
        pop = F.struct(F.slice(a["stack"], 2, F.greatest(F.size(a["stack"]) - 1, F.lit(0))).alias("stack"), F.coalesce(F.try_element_at(a["stack"], F.lit(1)), F.lit(-1)).alias("last"), a["n"].alias("n"), a["out"].alias("out"))
        put = F.struct(a["stack"].alias("stack"), a["n"].alias("last"), (a["n"] + 1).alias("n"), F.concat(a["out"], F.array(node)).alias("out"))
        return F.when(t == ")", push).when(t == "(", pop).otherwise(put)

    rows = df.select(key, F.explode(F.aggregate(tokens, start, step, lambda a: a["out"])).alias("r"))
    part = lambda k: F.regexp_extract("r.token", r"^([A-Z]+)([ab?])([0-9?]?)$", k)
    return rows.select(key, "r.place", "r.parent", part(1).alias("code"), part(2).alias("anomer"), F.nullif(part(3), F.lit("")).alias("pos"))


def linear_rejects(df: DataFrame, key: str, text: str, codes: list[str]) -> DataFrame:
    """(key, reason) of sequences that cannot be read: left-over text, unknown symbol, unbalanced brackets."""
    rest = F.regexp_replace(text, TOKEN, "")
    symbols = F.expr(f"regexp_extract_all({text}, '([A-Z]+)[ab?]', 1)")
    unknown = F.exists(symbols, lambda s: ~s.isin(*codes))
    open_, close = (F.length(text) - F.length(F.replace(text, F.lit(b), F.lit(""))) for b in "()")
    reason = F.when(rest != "", "bad format").when(unknown, "unknown symbol").when(open_ != close, "unbalanced")
    return df.select(key, reason.alias("reason")).filter("reason is not null")


NAME = r"^(F?)A([1-4])(B?)(?:G([0-9]))?(?:S([0-9]))?$"


def named(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, fucose, antennae, bisected, galactoses, sialic, reason): parts of an oxford name; reason if it cannot be built."""
    part = lambda k: F.regexp_extract(name, NAME, k)
    n = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract({name}, '{NAME}', {k}) as int)"), F.lit(0))
    rows = df.select(key, name, (part(1) == "F").alias("fucose"), n(2).alias("antennae"), (part(3) == "B").alias("bisected"), n(4).alias("galactoses"), n(5).alias("sialic"))
    reason = F.when(~F.col(name).rlike(NAME), "bad name").when(F.col("galactoses") > F.col("antennae"), "more galactoses than antennae").when(F.col("sialic") > F.col("galactoses"), "more sialic acids than galactoses")
    return rows.withColumn("reason", reason)


# Which core mannose an antenna hangs on, and at which position.
ANTENNAE = [(1, 3, 2), (2, 4, 2), (3, 3, 4), (4, 4, 6)]


# The core of a name, as residue, symbol, parent and position.
CORE = [(0, "GlcNAc", None, None), (1, "GlcNAc", 0, 4), (2, "Man", 1, 4), (3, "Man", 2, 3), (4, "Man", 2, 6)]


def expanded(parts: DataFrame, antennae: DataFrame, key: str) -> DataFrame:
    """(key, residue, symbol, parent, pos) rows of each readable name: the core, then antennae with what they carry."""
    good = parts.filter("reason is null")
    core = good.select(key, F.explode(F.array(*(F.struct(F.lit(r).alias("residue"), F.lit(s).alias("symbol"), F.lit(p).cast("int").alias("parent"), F.lit(q).cast("int").alias("pos")) for r, s, p, q in CORE))).alias("r")).select(key, "r.*")
    extra = good.filter("fucose").select(key, F.lit(5).alias("residue"), F.lit("Fuc").alias("symbol"), F.lit(0).alias("parent"), F.lit(6).alias("pos"))
    bisect = good.filter("bisected").select(key, F.lit(6).alias("residue"), F.lit("GlcNAc").alias("symbol"), F.lit(2).alias("parent"), F.lit(4).alias("pos"))
    on = good.join(F.broadcast(antennae), F.col("antenna") <= F.col("antennae"))  # four rows
    first = on.select(key, (F.col("antenna") * 10).alias("residue"), F.lit("GlcNAc").alias("symbol"), F.col("mannose").alias("parent"), F.col("position").alias("pos"))
    second = on.filter("antenna <= galactoses").select(key, (F.col("antenna") * 10 + 1).alias("residue"), F.lit("Gal").alias("symbol"), (F.col("antenna") * 10).alias("parent"), F.lit(4).alias("pos"))
    third = on.filter("antenna <= sialic").select(key, (F.col("antenna") * 10 + 2).alias("residue"), F.lit("NeuAc").alias("symbol"), (F.col("antenna") * 10 + 1).alias("parent"), F.lit(6).alias("pos"))
    out = core
    for more in (extra, bisect, first, second, third):
        out = out.unionByName(more)
    return out


def instantiation_counts(options: DataFrame) -> DataFrame:
    """(glycan_id, n): ways to give every floating root one of its candidate parents; rows (glycan_id, node, candidate). Exact; beyond 64 bits it is an overflow error."""
    per_root = options.groupBy("glycan_id", "node").agg(F.count("*").alias("k"))
    return per_root.groupBy("glycan_id").agg(F.aggregate(F.collect_list("k"), F.lit(1).cast("long"), lambda n, k: n * k).alias("n"))


def instantiations(options: DataFrame) -> DataFrame:
    """(glycan_id, choice): each combination as an array of candidate parents by floating root; one join for each root of the glycan with most."""
    ordinal = F.dense_rank().over(Window.partitionBy("glycan_id").orderBy("node"))
    rows = cut(options.withColumn("k", ordinal))
    most = rows.agg(F.max("k")).first()[0] or 0
    level = rows.filter("k = 1").select("glycan_id", F.array("candidate").alias("choice"))
    done = None
    last = rows.groupBy("glycan_id").agg(F.max("k").alias("last"))
    for k in range(1, most + 1):
        level = cut(level)
        whole = level.join(last.filter(F.col("last") == k), "glycan_id", "left_semi")
        done = whole if done is None else done.unionByName(whole)
        level = level.join(rows.filter(F.col("k") == k + 1).select("glycan_id", "candidate"), "glycan_id").select("glycan_id", F.concat("choice", F.array("candidate")).alias("choice"))
    return done if done is not None else level


def links_repaired(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links (glycan_id, parent, child, parent_pos, child_pos) with a column ``reversed``; nodes are (glycan_id, node).

    Where a glycan has several nodes without a parent, but not all are, and all of those but one have a single link, as its parent
    and with both positions unknown, such links are turned round. All other glycans keep their links.
    """
    heads = nodes.join(links.select("glycan_id", F.col("child").alias("node")), ["glycan_id", "node"], "left_anti")
    ends = links.select("glycan_id", F.explode(F.array("parent", "child")).alias("node")).groupBy("glycan_id", "node").agg(F.count("*").alias("degree"))
    loose = links.filter("parent_pos is null and child_pos is null").select("glycan_id", F.col("parent").alias("node"), F.lit(1).alias("loose"))
    heads = heads.join(ends, ["glycan_id", "node"], "left").join(loose, ["glycan_id", "node"], "left").withColumn("turn", F.coalesce((F.col("degree") == 1) & F.col("loose").isNotNull(), F.lit(False)))
    heads = heads.dropDuplicates(["glycan_id", "node"])
    every = nodes.groupBy("glycan_id").agg(F.count("*").alias("n_nodes"))
    good = heads.groupBy("glycan_id").agg(F.count("*").alias("n_heads"), F.count_if("turn").alias("n_turn")).join(every, "glycan_id").filter("n_heads > 1 and n_heads < n_nodes and n_turn = n_heads - 1")
    turned = heads.filter("turn").join(good, "glycan_id", "left_semi").select("glycan_id", F.col("node").alias("parent"), F.lit(True).alias("turned"))
    rows = links.join(turned, ["glycan_id", "parent"], "left").withColumn("reversed", F.col("turned").isNotNull())
    swap = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a)).alias(a)
    return rows.select("glycan_id", swap("parent", "child"), swap("child", "parent"), swap("parent_pos", "child_pos"), swap("child_pos", "parent_pos"), "reversed")
