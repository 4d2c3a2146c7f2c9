"""Fixed fact tables: elements, units, symbols, colours. Values are facts of chemistry and of the notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Monoisotopic and average masses.
ELEMENTS = [("H", 1.007825035, 1.00794), ("C", 12.0, 12.0107), ("N", 14.003074, 14.0067), ("O", 15.99491463, 15.9994), ("Na", 22.9897677, 22.98977), ("P", 30.973762, 30.973761), ("S", 31.9720707, 32.065)]
# Shares of isotopes by neutrons above the lightest.
ISOTOPES = [("H", 0, 0.999885), ("H", 1, 0.000115), ("C", 0, 0.9893), ("C", 1, 0.0107), ("N", 0, 0.99632), ("N", 1, 0.00368), ("O", 0, 0.99757), ("O", 1, 0.00038), ("O", 2, 0.00205)]
# Masses and shares of isotopes by neutrons above the lightest.
ISOTOPE_MASSES = [
    ("H", 0, 1.007825035, 0.999885), ("H", 1, 2.014101779, 0.000115), ("C", 0, 12.0, 0.9893), ("C", 1, 13.003354826, 0.0107), ("N", 0, 14.003074002, 0.99632), ("N", 1, 15.00010897, 0.00368),
    ("O", 0, 15.99491463, 0.99757), ("O", 1, 16.9991312, 0.00038), ("O", 2, 17.9991603, 0.00205),
]
# Element counts of units, native and added by permethylation.
UNITS = [
    ("HEX", "C", 6, 3), ("HEX", "H", 10, 6), ("HEX", "O", 5, 0),
    ("NON", "C", 9, 6), ("NON", "H", 16, 12), ("NON", "O", 8, 0),
    ("d", "O", -1, 0), ("d", "C", 0, -1), ("d", "H", 0, -2),
    ("a", "H", -2, 0), ("a", "O", 1, 0),
    ("n-acetyl", "C", 2, 0), ("n-acetyl", "H", 3, 0), ("n-acetyl", "N", 1, 0),
    ("n-glycolyl", "C", 2, 1), ("n-glycolyl", "H", 3, 2), ("n-glycolyl", "N", 1, 0), ("n-glycolyl", "O", 1, 0),
]
# Symbol, superclass, stem, modifications, substituents, class of the composition, one-letter code with its rank.
SYMBOL_KEYS = [
    ("GlcNAc", "HEX", "glc", "", "n-acetyl", "HexNAc", "GN", 3), ("NeuAc", "NON", "gro-gal", "a|keto|d", "n-acetyl", "Sia", "NN", 6), ("Fuc", "HEX", "gal", "d", "", "dHex", "F", 5), ("Man", "HEX", "man", "", "", "Hex", "M", 2),
    ("GalNAc", "HEX", "gal", "", "n-acetyl", "HexNAc", "AN", 4), ("Gal", "HEX", "gal", "", "", "Hex", "A", 1), ("Glc", "HEX", "glc", "", "", "Hex", "G", 0), ("NeuGc", "NON", "gro-gal", "a|keto|d", "n-glycolyl", "Sia", "NJ", 7),
]
# Other names of the symbols.
ALIASES = [("N-acetylglucosamine", "GlcNAc"), ("Neu5Ac", "NeuAc"), ("Sia", "NeuAc"), ("Fucose", "Fuc"), ("dHex", "Fuc"), ("Mannose", "Man"), ("Galactose", "Gal"), ("Glucose", "Glc"), ("Neu5Gc", "NeuGc")]
# Hue, saturation and value ranges of symbol colours.
COLOURS = [
    ("black", 0, 0, 0, 180, 171, 235), ("red", 0, 18, 120, 19, 255, 255), ("yellow", 20, 62, 104, 36, 255, 255), ("green", 37, 40, 70, 77, 255, 255),
    ("blue", 87, 40, 60, 134, 255, 255), ("purple", 135, 20, 40, 169, 255, 225), ("red", 156, 40, 120, 180, 255, 255),
]


def small(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A fixed table of a few rows, broadcast in joins."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def elements(spark: SparkSession) -> DataFrame:
    return small(spark, ELEMENTS, "element string, mono double, average double")


def isotopes(spark: SparkSession) -> DataFrame:
    return small(spark, ISOTOPE_MASSES, "element string, neutrons int, mass double, share double")


def units(spark: SparkSession) -> DataFrame:
    return small(spark, UNITS, "unit string, element string, native int, permethyl_added int")


def symbol_keys(spark: SparkSession) -> DataFrame:
    return small(spark, SYMBOL_KEYS, "symbol string, superclass string, stem string, mods string, substituents string, roll_up string, code string, code_rank int")


def colours(spark: SparkSession) -> DataFrame:
    return small(spark, COLOURS, "colour string, h_lo int, s_lo int, v_lo int, h_hi int, s_hi int, v_hi int")


def values(name: str, columns: str, rows: list) -> str:
    """The same table as a DuckDB common table expression."""
    one = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


SQL_ELEMENTS = values("elements", "element, mono, average", ELEMENTS)
SQL_UNITS = values("units", "unit, element, native, permethyl_added", UNITS)
SQL_KEYS = values("symbol_keys", "symbol, superclass, stem, mods, substituents, roll_up, code, code_rank", SYMBOL_KEYS)
SQL_COLOURS = values("colours", "colour, h_lo, s_lo, v_lo, h_hi, s_hi, v_hi", COLOURS)
SQL_ALIASES = values("aliases", "alias, symbol", ALIASES)
