"""Named queries over the derived figure tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sugarmill.plans import annotation, base, boxes, chain, composition, dags, detections, evaluation, files, notation, overlap, pixels, references, residues, scans, trees, undetermined, wurcs  # noqa: F401  each module registers its queries
from sugarmill.plans.base import Query


def queries() -> dict[str, Query]:
    """Every query of the figure engine by name."""
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(base.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end-to-end annotation."""
    return queries()["annotate"](spark, sf_dir)
