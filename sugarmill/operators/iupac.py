"""Compositions by IUPAC symbols: each symbol, substituents written with a plus, unknown residues, and classes rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbols of residues, of substituents, and the symbols that a class sums up.
RESIDUES = ["Man", "Gal", "Glc", "Xyl", "Fuc", "ManNAc", "GlcNAc", "GalNAc", "NeuAc", "NeuGc", "Hex", "HexNAc", "dHex", "Pent", "Sia", "GlcA", "GalA", "IdoA", "ManA", "HexA", "GlcN", "GalN", "ManN", "HexN"]
SUBSTITUENTS = ["S", "P", "Me", "aldi"]
CLASSES = {
    "Hex": ["Man", "Gal", "Glc", "Hex"], "HexNAc": ["GalNAc", "GlcNAc", "ManNAc", "HexNAc"], "dHex": ["Fuc", "dHex"], "Pent": ["Xyl", "Pent"], "Sia": ["NeuAc", "NeuGc", "Sia"],
    "HexA": ["GlcA", "GalA", "IdoA", "ManA", "HexA"], "HexN": ["GlcN", "GalN", "ManN", "HexN"],
}
COLUMNS = [*RESIDUES, *SUBSTITUENTS, "Xxx", "X", "Count"]


def names_of(symbol: Column, monosaccharide: Column, plus: bool = True) -> Column:
    """What a residue counts as. No symbol: Xxx, or X for a substituent. A symbol that is unknown or carries an unknown substituent: Xxx.
    Else its residue and, with ``plus``, each substituent after a plus."""
    parts = F.transform(F.split(symbol, r"\+"), lambda x: F.trim(x)) if plus else F.array(F.trim(symbol))
    known = F.get(parts, F.lit(0)).isin(*RESIDUES, *SUBSTITUENTS) & ~F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~x.isin(*SUBSTITUENTS))
    return F.when(symbol.isNull(), F.array(F.when(monosaccharide, "Xxx").otherwise("X"))).when(known, parts).otherwise(F.array(F.lit("Xxx")))


def composition(residues: DataFrame, key: str, plus: bool = True, roll_up: bool = True) -> DataFrame:
    """(key, ``COLUMNS``) from rows (key, symbol, monosaccharide): counts by name; ``Count`` is the residues, unknown ones included.

    With ``roll_up`` a class counts its symbols too, so the columns overlap. A fixed table leads from a name to all columns that it
    counts in, so one aggregate gives all of them.
    """
    spark = residues.sparkSession
    targets = {c: [c] for c in COLUMNS[:-1]}
    for c in [*RESIDUES, "Xxx"]:
        targets[c].append("Count")
    if roll_up:
        for name, members in CLASSES.items():
            for c in members:
                if c != name:
                    targets[c].append(name)
    table = spark.createDataFrame(list(targets.items()), "name string, targets array<string>")
    names = residues.select(key, F.explode(names_of(F.col("symbol"), F.coalesce("monosaccharide", F.lit(True)), plus)).alias("name"))
    each = names.join(F.broadcast(table), "name").select(key, F.explode("targets").alias("target"))
    return each.groupBy(key).agg(*(F.count_if(F.col("target") == c).alias(c) for c in COLUMNS))
