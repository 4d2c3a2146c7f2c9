"""Reading and writing WURCS 2.0 texts: unique residues, sequence, links with alternatives; and the codes of residues.

A text is opened by one pattern into its counts and three lists, which explode to rows. Codes of residues repeat in almost every text, so
they are decoded once each, by array functions over the carbons of the skeleton.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarmill.functions.lineage import cut
from sugarmill.operators.notation import links_repaired

WHOLE = r"^WURCS=2\.0/(\d+),(\d+),(\d+)(\+?)/((?:\[[^\]]+\])+)/(\d+(?:-\d+)*)/(.*)$"
LETTERS = string.ascii_lowercase + string.ascii_uppercase
END = r"[a-zA-Z]{1,2}[0-9?]"
ENDS = rf"{END}(?:\|{END})*"
LINK = rf"^({END})-({ENDS})(\}}?)(?:\*(.*))?$"
NO_LINK = rf"^({ENDS})\}}-\{{\1$"
FLOATING = rf"^{ENDS}\}}(?:-\{{{ENDS})?\*(.*)$"
UNIT = r"^([0-9a-zA-Z]{3,9})(?:-\d([abx])(?:_([0-9?])-([0-9?]))?)?((?:_(?:[0-9?]|\d\|\d|\d-\d)(?:\*[^_]+)?)*)$"

# Stems by the configuration of their centres, the last of which is 2.
STEMS = {
    "2": "gro", "22": "ery", "12": "thr", "222": "rib", "122": "ara", "212": "xyl", "112": "lyx",
    "2222": "all", "1222": "alt", "2122": "glc", "1122": "man", "2212": "gul", "1212": "ido", "2112": "gal", "1112": "tal",
}
# Names of chains by length, from 3 on.
SUPERCLASSES = ["TRI", "TETRA", "PENT", "HEX", "HEPT", "OCT", "NON"]
# Substituents by what they add to a carbon; each keeps or takes the carbon's oxygen or a hydrogen.
SUBSTITUENTS = [
    ("NCC/3=O", "nAcetyl", "oxygenLost"), ("OSO/3=O/3=O", "sulfate", "oxygenPreserved"), ("SO/2=O/2=O", "sulfate_oxygen_lost", "oxygenLost"), ("C", "methyl_oxygen_lost", "oxygenLost"), ("OC", "methyl", "oxygenPreserved"),
    ("OCC/3=O", "acetyl", "oxygenPreserved"), ("CC/2=O", "acetyl_oxygen_lost", "oxygenLost"), ("N", "amino", "oxygenLost"), ("ON", "amino_oxygen_preserved", "oxygenPreserved"), ("NSO/3=O/3=O", "nsulfate", "oxygenLost"),
    ("NCCO/3=O", "nglycolyl", "oxygenLost"), ("OP^XOCCN/3O/3=O", "phosphoethanolamine", "oxygenPreserved"), ("OPO/3O/3=O", "phosphate", "oxygenPreserved"), ("PO/2O/2=O", "phosphate_oxygen_lost", "oxygenLost"),
    ("OPO*/3O/3=O", "phosphate_bridged", "oxygenPreserved"), ("NC", "nmethyl", "oxygenLost"), ("anhydro", "anhydro", "oxygenLost"), ("anhydro1", "anhydro", "oxygenPreserved"), ("NCCCCO/6=O/3=O", "nsuccinate", "oxygenLost"),
    ("OC^XO*/3CO/6=O/3C", "pyruvate", "oxygenPreserved"), ("OP^XOP^XOCCN/5O/5=O/3O/3=O", "diphosphoethanolamine", "oxygenPreserved"), ("OP^XOPO/5O/5=O/3O/3=O", "pyrophosphate", "oxygenPreserved"), ("OC=O", "formyl", "oxygenPreserved"),
    ("S", "thio", "oxygenLost"), ("F", "fluoro", "oxygenLost"), ("Br", "bromo", "oxygenLost"), ("OCCO/3=O", "glycolyl", "oxygenPreserved"), ("NC/2C", "ndimethyl", "oxygenLost"), ("Cl", "chloro", "oxygenLost"), ("OCC", "ethyl", "oxygenPreserved"),
    ("OCCCCO/6=O/3=O", "succinate", "oxygenPreserved"), ("NC=O", "nformyl", "oxygenLost"), ("NCN/3=N", "namidino", "oxygenLost"), ("I", "iodo", "oxygenLost"), ("NCCO", "ethanolamine", "oxygenLost"),
    ("OCC^SC/4O/3=O", "slactate", "oxygenPreserved"), ("OCC^RC/4O/3=O", "rlactate", "oxygenPreserved"), ("OCC^XC/4O/3=O", "xlactate", "oxygenPreserved"), ("OP^XOP^XOPO/7O/7=O/5O/5=O/3O/3=O", "triphosphate", "oxygenPreserved"),
    ("OC^RCO/4=O/3C", "rcarboxyethyl", "oxygenPreserved"), ("OC^SCO/4=O/3C", "scarboxyethyl", "oxygenPreserved"), ("OP^XOCCNC/7C/7C/3O/3=O", "phosphocholine", "oxygenPreserved"), ("CO", "hydroxymethyl", "hydrogenLost"),
]


def table_of(pairs: list[tuple[str, str]]) -> Column:
    """A small lookup table as a column."""
    return F.map_from_arrays(F.lit([a for a, _ in pairs]), F.lit([b for _, b in pairs]))


def number(letters: Column) -> Column:
    """The number of a residue from its one or two letters: a to z, A to Z, then aa and on."""
    place = lambda c: F.instr(F.lit(LETTERS), c)
    return F.when(F.length(letters) == 1, F.instr(F.lit(LETTERS), letters)).otherwise(place(F.substring(letters, 1, 1)) * 52 + place(F.substring(letters, 2, 1)))


def lettered(n: Column) -> Column:
    """The letters of a residue's number."""
    one = lambda k: F.substring(F.lit(LETTERS), k, F.lit(1))
    last = (n - 1) % 52 + 1
    return F.when(n <= 52, one(n)).otherwise(F.concat(one(((n - last) / 52).cast("int")), one(last)))


def opened(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form, n_units, n_residues, n_links, open, units, sequence, links) of every text; ``form`` tells whether it is one."""
    part = lambda k: F.regexp_extract(text, WHOLE, k)
    whole = lambda k: part(k).try_cast("int")
    units = F.split(F.substring(part(5), F.lit(2), F.length(part(5)) - 2), r"\]\[")
    links = F.filter(F.transform(F.split(part(7), "_"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(
        key, F.coalesce(F.col(text).rlike(WHOLE), F.lit(False)).alias("form"), whole(1).alias("n_units"), whole(2).alias("n_residues"), whole(3).alias("n_links"), (part(4) == "+").alias("open"), units.alias("units"),
        F.transform(F.split(part(6), "-"), lambda x: x.try_cast("int")).alias("sequence"), links.alias("links"),
    )


def residues(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, residue, unit): every residue by its place in the sequence, with its code; null where the text has no such unit."""
    rows = opened(docs, key, text).filter("form").select(key, "units", F.posexplode("sequence").alias("at", "no"))
    return rows.select(key, (F.col("at") + 1).alias("residue"), F.get("units", F.col("no") - 1).alias("unit"))


def ends(text: Column) -> Column:
    """(residue, pos) of each of the alternatives a1|b2|..; an unknown position is null."""
    return F.transform(F.split(text, r"\|"), lambda x: F.struct(number(F.substring(x, F.lit(1), F.length(x) - 1)).alias("residue"), F.right(x, F.lit(1)).try_cast("int").alias("pos")))


def read_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, link, line, kind, one, many, bridge): every item of the link lists with its kind and ends.

    Kinds: simple, positions (one parent, alternative positions), bridge (through a substituent), parents (alternative parents),
    composition (no link), floating (a substituent of no known residue), order (ends in the wrong order), unsupported.
    """
    rows = opened(docs, key, text).filter("form").select(key, F.posexplode("links").alias("at", "line"))
    part = lambda k: F.regexp_extract("line", LINK, k)
    rows = rows.select(key, (F.col("at") + 1).alias("link"), "line", F.col("line").rlike(LINK).alias("links"), F.get(ends(part(1)), F.lit(0)).alias("one"), ends(part(2)).alias("many"), (part(3) != "").alias("brace"), F.when(F.col("line").contains("*"), F.regexp_extract("line", r"\*(.*)$", 1)).alias("bridge"))
    n, kinds = F.size("many"), F.size(F.array_distinct(F.transform("many", lambda x: x["residue"])))
    low, high = F.array_min(F.transform("many", lambda x: x["residue"])), F.array_max(F.transform("many", lambda x: x["residue"]))
    first = F.get("many", F.lit(0))["pos"]
    usual = first.isNull() | first.isin(1, 2)
    turned = (F.col("one.pos") == 1) & ~usual
    single = F.when(F.col("one.residue") >= low, "order").when(usual | F.coalesce(turned, F.lit(False)), "simple").otherwise("unsupported")
    kind = (
        F.when(F.col("line").rlike(NO_LINK), "composition").when(F.col("line").rlike(FLOATING), "floating").when(~F.col("links"), "unsupported")
        .when(F.col("bridge").isNotNull(), F.when((n > 1) | F.col("brace"), "unsupported").when(F.col("one.residue") >= low, "order").otherwise("bridge"))
        .when(F.col("brace"), F.when(n == 1, "unsupported").when(high >= F.col("one.residue"), "order").when(kinds < 2, "unsupported").otherwise("parents"))
        .when(n == 1, single).when(kinds > 1, "unsupported").when(high >= F.col("one.residue"), "order").otherwise("positions")
    )
    return rows.select(key, "link", "line", kind.alias("kind"), "one", "many", "bridge")


def links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, link, kind, parent, parent_pos, child, child_pos, bridge, undetermined): a row for each link and possible parent.

    ``parent_pos`` lists the alternatives, null where the position is unknown. A simple link whose second end is neither 1 nor 2
    nor unknown, and whose first is 1, goes from the second to the first.
    """
    return links_of(cut(read_links(docs, key, text)), key)


def links_of(items: DataFrame, key: str) -> DataFrame:
    """The rows of ``links`` from those of ``read_links``."""
    rows = items.filter("kind in ('simple', 'positions', 'bridge', 'parents')")
    first = F.get("many", F.lit(0))
    up = (F.col("kind") == "simple") & first["pos"].isNotNull() & ~first["pos"].isin(1, 2)
    listed = lambda p: F.when(p.isNotNull(), F.array(p))
    end = lambda parent, pos, child, child_pos: F.struct(parent.alias("parent"), pos.alias("parent_pos"), child.alias("child"), child_pos.alias("child_pos"))
    one = F.col("one")
    many = F.transform(
        F.array_sort(F.array_distinct(F.transform("many", lambda x: x["residue"]))),
        lambda r: end(r, positions(F.filter("many", lambda x: x["residue"] == r)), one["residue"], one["pos"]),
    )
    each = F.when(F.col("kind").isin("positions", "parents"), many).when(up, F.array(end(first["residue"], listed(first["pos"]), one["residue"], one["pos"]))).otherwise(F.array(end(one["residue"], listed(one["pos"]), first["residue"], first["pos"])))
    return rows.select(key, "link", "kind", F.explode(each).alias("e"), "bridge").select(key, "link", "kind", "e.*", F.regexp_replace("bridge", r"\*", "").alias("bridge"), (F.col("kind") == "parents").alias("undetermined"))


def positions(found: Column) -> Column:
    """The sorted distinct positions of some ends; null where one is unknown."""
    pos = F.transform(found, lambda x: x["pos"])
    return F.when(~F.exists(pos, lambda p: p.isNull()), F.array_sort(F.array_distinct(pos)))


def floating(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, link, substituent): substituents whose residue is unknown."""
    return read_links(docs, key, text).filter("kind = 'floating'").select(key, "link", F.regexp_extract("line", FLOATING, 1).alias("substituent"))


def rejects(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason) of texts that cannot be read as one structure: the first that holds of bad form, open link count, unit missing,
    residue missing, wrong order, unsupported link, link count, circular, not connected, floating substituent.

    A structure has one residue without a parent, after links with both positions unknown have been turned where that helps; a
    composition has no link at all. Floating substituents count as links and only stand in compositions.
    """
    texts = opened(docs, key, text)
    read = cut(read_links(docs, key, text))
    items = read.groupBy(key).agg(F.bool_or(F.col("kind") == "order").alias("order"), F.bool_or(F.col("kind") == "unsupported").alias("odd"), F.count_if(F.col("kind") == "floating").alias("n_floating"))
    nodes = residues(docs, key, text).select(F.col(key).alias("glycan_id"), F.col("residue").alias("node"))
    own = links_of(read, key).select(F.col(key).alias("glycan_id"), "parent", "child", F.col("parent_pos")[0].alias("parent_pos"), "child_pos")
    there = nodes.select("glycan_id", F.col("node").alias("n"))
    lost = lambda c: own.join(there, (own["glycan_id"] == there["glycan_id"]) & (own[c] == there["n"]), "left_anti").select(F.col("glycan_id").alias(key))
    lost = lost("parent").unionByName(lost("child")).distinct().withColumn("lost", F.lit(True))
    kids = links_repaired(nodes, own).select("glycan_id", F.col("child").alias("node")).distinct().withColumn("has", F.lit(1))
    heads = nodes.join(kids, ["glycan_id", "node"], "left").groupBy(F.col("glycan_id").alias(key)).agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("heads"))
    unit = F.exists("sequence", lambda x: x.isNull() | (x < 1) | (x > F.size("units")))
    rows = texts.join(items, key, "left").join(lost, key, "left").join(heads, key, "left")
    n_floating = F.coalesce("n_floating", F.lit(0))
    reason = (
        F.when(~F.col("form"), "bad form").when(F.col("open"), "open link count").when(unit, "unit missing").when(F.col("lost"), "residue missing").when(F.col("order"), "wrong order").when(F.col("odd"), "unsupported link")
        .when(~F.col("n_links").eqNullSafe(F.col("n_residues") - 1 + n_floating), "link count").when(F.col("heads") == 0, "circular")
        .when((F.col("heads") > 1) & (F.col("heads") < F.col("n")), "not connected").when((F.col("heads") == 1) & (F.col("n") > 1) & (n_floating > 0), "floating substituent")
    )
    return rows.select(key, reason.alias("reason")).filter("reason is not null")


def stem(values: Column) -> Column:
    """The stem of some centres (1 and 2, x for unknown): null where it cannot be told."""
    turned = F.when(F.right(values, F.lit(1)) == "1", F.translate(values, "12", "21")).otherwise(values)
    return F.when(values.contains("x"), F.when(F.length(values) == 1, "gro")).otherwise(F.try_element_at(table_of(list(STEMS.items())), turned))


def config(values: Column, relative: Column) -> Column:
    """d or l from the last of some centres; null where it is unknown or only relative."""
    return F.when(~values.contains("x") & ~relative, F.when(F.right(values, F.lit(1)) == "1", "l").otherwise("d"))


def decoded(codes: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, anomer, ring_start, ring_end, superclass, stems, configs, mods, substituents, reason): each distinct code once.

    A skeleton has a letter for each carbon. First: a and u may close a ring, h is an alditol and o an aldehyde unless the second carbon is
    the carbonyl (keto), A an acid. Then 1 to 8 and x are centres, d is deoxy, and neighbours of E, F, Z (small: deoxy too) are unsaturated. Last:
    h, m (deoxy) or A (acid). The first four centres are a stem, further ones another, which stands before it; stems that unknown centres
    leave open are not listed, but a lone unknown centre is ``gro``. ``mods`` and ``substituents`` are in the order of their positions; a
    substituent's positions are alternatives, null where unknown. ``reason`` tells why a code cannot be read; its fields are null then.
    """
    rows = codes.select(unit).distinct().filter(F.col(unit).isNotNull())
    part = lambda k: F.regexp_extract(unit, UNIT, k)
    rows = rows.select(unit, F.col(unit).rlike(UNIT).alias("form"), part(1).alias("s"), part(2).alias("letter"), part(3).alias("r1"), part(4).alias("r2"), F.filter(F.split(part(5), "_"), lambda x: x != "").alias("added"))
    rows = rows.withColumns({"n": F.length("s"), "first": F.left("s", F.lit(1)), "second": F.substring("s", 2, 1), "last": F.right("s", F.lit(1))})
    rows = rows.withColumn("inner", F.substring(F.col("s"), F.lit(2), F.col("n") - 2))
    rows = rows.withColumns({"ketose": F.col("second").isin("a", "U", "k", "O") & (F.col("n") > 3), "centres": F.regexp_replace("inner", "[^1-8x]", "")})
    rows = rows.withColumns({"values": F.translate("centres", "12345678", "12121212"), "relative": F.col("centres").rlike("[3478]"), "chain": F.col("first").isin("h", "o") & ~F.col("ketose") | (F.col("second") == "O")})
    v1, v2, rel = F.substring("values", 1, 4), F.substring("values", 5, 5), F.col("relative")
    stems = F.when(F.length(v2) > 0, F.array(stem(v2), stem(v1))).when(F.length(v1) > 0, F.array(stem(v1))).otherwise(F.array().cast("array<string>"))
    known = ~F.exists(stems, lambda x: x.isNull())
    configs = F.when(F.length(v2) > 0, F.array(config(v2, rel), config(v1, rel))).otherwise(F.array(config(v1, rel)))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"stems": F.when(known, stems).otherwise(none), "configs": F.when(known & (F.length(v1) > 0), configs).otherwise(none)})
    mod = lambda pos, name, to=None: F.struct(F.lit(pos).cast("int").alias("pos") if isinstance(pos, int) else pos.cast("int").alias("pos"), (F.lit(None) if to is None else to).cast("int").alias("to"), F.lit(name).alias("mod"))
    blank = F.array().cast("array<struct<pos:int,to:int,mod:string>>")
    only = lambda test, *m: F.when(test, F.array(*m)).otherwise(blank)
    at = lambda i: F.substring(F.col("s"), i, F.lit(1))
    places = F.sequence(F.lit(2), F.col("n") - 1)
    bond = lambda i: at(i).rlike("[EFZefz]")
    mods = F.concat(
        only((F.col("first") == "A"), mod(1, "a")), only(F.col("first").isin("A", "h") & ~F.col("ketose"), mod(1, "aldi")), only(F.col("ketose"), mod(2, "keto")),
        F.transform(F.filter(places, lambda i: at(i).isin("d", "e", "f", "z")), lambda i: mod(i, "d")),
        F.transform(F.filter(places, lambda i: bond(i) & bond(i + 1) & ~bond(i - 1)), lambda i: mod(i, "enx", i + 1)),
        only(F.col("last") == "m", mod(F.col("n"), "d")), only(F.col("last") == "A", mod(F.col("n"), "a")),
    )
    mods = F.array_sort(mods, lambda x, y: F.when(x["pos"] != y["pos"], x["pos"] - y["pos"]).when(x["mod"] < y["mod"], -1).when(x["mod"] > y["mod"], 1).otherwise(0))
    kinds, keeps = table_of([(a, b) for a, b, _ in SUBSTITUENTS]), table_of([(a, c) for a, _, c in SUBSTITUENTS])

    def one(pos: Column, name: Column) -> Column:
        return F.struct(F.when(pos != "?", F.transform(F.split(pos, r"\|"), lambda p: p.cast("int"))).alias("positions"), F.try_element_at(kinds, name).alias("kind"), F.try_element_at(keeps, name).alias("link"))

    def added(x: Column) -> Column:
        pos, name = F.substring_index(x, "*", 1), F.when(x.contains("*"), F.regexp_replace(x, r"^[^*]*\*", "")).otherwise("anhydro")
        two = F.split(pos, "-")
        return F.when(pos.contains("-"), F.array(one(two[0], name), one(F.get(two, F.lit(1)), F.when(name == "anhydro", "anhydro1").otherwise(name)))).otherwise(F.array(one(pos, name)))

    substituents = F.flatten(F.transform("added", added))
    reason = (
        F.when(~F.col("form"), "bad code").when(~F.col("s").rlike("^[auhoA][1-8xdaUkOEFZefz]+[hmA]$") | F.substring(F.col("s"), F.lit(3), F.col("n") - 3).rlike("[aUkO]"), "unsupported skeleton")
        .when(F.col("chain") & (F.col("letter") != ""), "anomer of an open chain").when(F.exists("added", lambda x: ~x.contains("*") & ~x.rlike(r"^\d-\d$")), "bad code").when(F.exists(substituents, lambda x: x["kind"].isNull()), "unsupported substituent")
    )
    ring = lambda c: F.when(F.col(c) != "", F.col(c).try_cast("int")).when(F.col("chain"), 0)
    anomer = F.when(F.col("chain"), "uncyclized").when(F.col("letter") == "a", "alpha").when(F.col("letter") == "b", "beta")
    out = rows.select(unit, anomer.alias("anomer"), ring("r1").alias("ring_start"), ring("r2").alias("ring_end"), F.get(F.lit(SUPERCLASSES), F.col("n") - 3).alias("superclass"), "stems", "configs", mods.alias("mods"), substituents.alias("substituents"), reason.alias("reason"))
    return out.select(unit, *(F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in out.columns[1:-1]), "reason")


def written(nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, text) from rows of ``residues`` and ``links``: what reading it gives is those rows. Units are numbered as they come."""
    seq = nodes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("residue", "unit"))), lambda x: x["unit"]).alias("all"))
    seq = seq.withColumn("units", F.array_distinct("all"))
    pos = lambda p: F.coalesce(p.cast("string"), F.lit("?"))
    end = lambda r, p: F.concat(lettered(F.col(r)), pos(p))
    parents = F.when(F.col("parent_pos").isNull(), F.array(F.concat(lettered(F.col("parent")), F.lit("?")))).otherwise(F.transform("parent_pos", lambda p: F.concat(lettered(F.col("parent")), p.cast("string"))))
    first = F.when(F.col("parent_pos").isNotNull(), F.col("parent_pos")[0])
    simple = F.when(F.col("parent") < F.col("child"), F.concat(end("parent", first), F.lit("-"), end("child", F.col("child_pos")))).otherwise(F.concat(end("child", F.col("child_pos")), F.lit("-"), end("parent", first)))
    rows = found.select(key, "link", "kind", "parent", simple.alias("simple"), end("child", F.col("child_pos")).alias("low"), parents.alias("ends"), "bridge")
    rows = rows.groupBy(key, "link").agg(F.first("kind").alias("kind"), F.first("simple").alias("simple"), F.first("low").alias("low"), F.first("bridge").alias("bridge"), F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("parent", "ends"))), lambda x: x["ends"])), "|").alias("ends"))
    line = F.when(F.col("kind") == "simple", F.col("simple")).when(F.col("kind") == "bridge", F.concat("simple", F.lit("*"), F.regexp_replace("bridge", "^(.[^/]*)", "$1*"))).otherwise(F.concat("low", F.lit("-"), "ends", F.when(F.col("kind") == "parents", "}").otherwise("")))
    lines = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link", line.alias("line")))), lambda x: x["line"]), "_").alias("lines"), F.count("*").alias("n_links"))
    places = F.array_join(F.transform("all", lambda u: F.array_position("units", u).cast("string")), "-")
    counts = F.concat_ws(",", F.size("units").cast("string"), F.size("all").cast("string"), F.coalesce("n_links", F.lit(0)).cast("string"))
    return seq.join(lines, key, "left").select(key, F.concat(F.lit("WURCS=2.0/"), counts, F.lit("/["), F.array_join("units", "]["), F.lit("]/"), places, F.lit("/"), F.coalesce("lines", F.lit(""))).alias("text"))
