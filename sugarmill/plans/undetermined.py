"""Queries over structure texts with undetermined parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sugarmill.operators import textforms
from sugarmill.operators import undetermined as ops
from sugarmill.plans.base import NODES, query
from sugarmill.sources import derived, facts

#: The last residue of every third glycan has its parent and residue 1 as possible parents; glycan_id % 23 names the odd case, if any.
OPEN = f"WITH {NODES}, und AS (SELECT glycan_id, parent, parent_pos, glycan_id % 23 AS odd FROM nodes WHERE node = 7 AND glycan_id % 3 = 0)"


def texts(spark, d):
    n = derived.nodes(spark, d).join(facts.small(spark, [(k, f"{s[2]}-{s[1]}") for k, s in enumerate(facts.SYMBOL_KEYS)], "class_id int, body string"), "class_id")
    n = n.withColumns({"last": F.expr("glycan_id % 3 = 0 and node = 7"), "odd": F.expr("glycan_id % 23"), "line": F.expr("concat(node + 1, 'b:', anomer, '-', body)")})
    main = n.filter("not last")
    res = main.select("glycan_id", (F.col("node") + 1).alias("residue"), "line")
    lin = main.filter("parent is not null and odd <> 4 and not (odd = 6 and node = 1)").select("glycan_id", F.col("node").alias("link"), F.expr("concat(node, ':', parent + 1, 'o(', parent_pos, '+1)', node + 1, 'd')").alias("line"))
    text = textforms.structure_text(res, lin, "glycan_id").withColumn("text", F.expr("concat(text, if(glycan_id % 23 = 3, '\\nABC', ''))"))
    subs = n.filter("last").select(
        "glycan_id", F.lit(1).alias("und"), F.expr("case when odd = 1 then array(99L) else array_distinct(array(parent + 1, 1)) end").alias("parents"), F.expr("if(odd = 2, '?', concat('o(', parent_pos, '+1)d'))").alias("linkage"),
        F.array("line").alias("residues"), F.array().cast("array<string>").alias("links"),
    )
    return ops.with_subtrees(text, subs, "glycan_id")


@query("glycoct_und_links", f"{OPEN} SELECT DISTINCT glycan_id, 1 AS und, unnest(CASE WHEN odd = 1 THEN [99] ELSE [parent + 1, 1] END)::INT AS parent, 'o' AS parent_type, parent_pos, 1 AS child_pos, 8 AS child, 'd' AS child_type FROM und WHERE odd <> 2")
def glycoct_und_links(spark, d):
    return ops.undetermined_links(texts(spark, d), "glycan_id", "text")


@query("glycoct_und_residues", f"WITH {NODES} SELECT glycan_id, count(*)::INT AS n, max(node + 1)::INT AS last FROM nodes GROUP BY 1")
def glycoct_und_residues(spark, d):
    """Residues of a text, those of subtrees included."""
    rows = textforms.structure_residues(texts(spark, d), "glycan_id", "text")
    return rows.groupBy("glycan_id").agg(F.count("*").cast("int").alias("n"), F.max("residue").alias("last"))


@query("glycoct_und_rejects", f"""WITH {NODES}, g AS (SELECT DISTINCT glycan_id, glycan_id % 23 AS odd, glycan_id % 3 = 0 AS open FROM nodes)
SELECT glycan_id, CASE WHEN odd = 3 THEN 'unsupported section' WHEN odd = 1 THEN 'parent missing' WHEN odd = 2 THEN 'bad line' WHEN odd = 4 THEN 'UND before RES or LIN' ELSE 'unconnected count' END AS reason FROM g WHERE odd IN (3, 6) OR (open AND odd IN (1, 2, 4))""")
def glycoct_und_rejects(spark, d):
    return ops.rejects(texts(spark, d), "glycan_id", "text")
