"""Truth boxes, detections and glycan trees derived from the given tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ("GlcNAc", "NeuAc", "Fuc", "Man", "GalNAc", "Gal", "Glc", "NeuGc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth boxes: eight slots of an image on a 4 x 2 grid, some on their left neighbour."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as k", "o_orderkey div 8 as image_id", "case when o_orderkey % 5 = 0 and o_orderkey % 8 > 0 then o_orderkey % 8 - 1 else o_orderkey % 8 end as s2",
        "cast(40 + (o_orderkey * 7) % 30 as int) as w", "cast(40 + (o_orderkey * 13) % 30 as int) as h",
    )
    return base.selectExpr(
        "k as box_id", "image_id", "cast((image_id * 3 + s2) % 8 as int) as class_id", "cast(20 + (s2 % 4) * 150 + (k * 17) % 16 as int) as x",
        "cast(20 + (s2 div 4) * 180 + (k * 23) % 16 as int) as y", "w", "h", "640 as imwidth", "400 as imheight",
    )


#: Boxes of one task, about.
BOXES = 20_000


def dealt(boxes: DataFrame) -> DataFrame:
    """``boxes`` dealt by image to as many tasks as their number asks for, so that a task's share does not grow with the table; what is
    then joined or grouped by image needs no further exchange."""
    tasks = max(boxes.sparkSession.sparkContext.defaultParallelism, -(-boxes.count() // BOXES))
    return boxes.repartition(tasks, "image_id")


def first_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted truths, the first detection of each."""
    return truth(spark, sf_dir).filter("box_id % 11 <> 0").selectExpr(
        "box_id as det_id", "image_id", "cast(case when box_id % 13 = 0 then (class_id + 1) % 8 else class_id end as int) as class_id",
        "cast(x + (box_id * 31) % 11 - 5 as int) as x", "cast(y + (box_id * 37) % 11 - 5 as int) as y",
        "cast(w + (box_id * 41) % 9 - 4 as int) as w", "cast(h + (box_id * 43) % 9 - 4 as int) as h", "cast((box_id * 7919) % 9901 as double) / 10000 as conf",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: shifted truths, second ones, and false ones. From 1,000,000 orders on an id stands for one detection only within its image."""
    t = truth(spark, sf_dir)
    first = first_detections(spark, sf_dir)
    second = t.filter("box_id % 3 = 0").selectExpr(
        "1000000 + box_id as det_id", "image_id", "class_id", "cast(x + (box_id * 53) % 21 - 10 as int) as x", "cast(y + (box_id * 59) % 21 - 10 as int) as y", "w", "h",
        "cast((box_id * 104729) % 9901 as double) / 10000 as conf",
    )
    false = table(spark, sf_dir, "events").filter("event_id % 20 = 0").selectExpr(
        "2000000 + event_id as det_id", "event_id div 8 as image_id", "cast(event_id % 8 as int) as class_id", "cast((event_id * 29) % 560 as int) as x", "cast((event_id * 31) % 330 as int) as y",
        "cast(40 + event_id % 30 as int) as w", "cast(40 + (event_id * 3) % 30 as int) as h", "cast((event_id * 6101) % 9901 as double) / 10000 as conf",
    )
    return first.unionByName(second).unionByName(false)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glycan trees of at most eight nodes."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 8 as glycan_id", "o_orderkey % 8 as node", "case when o_orderkey % 8 = 0 then null else o_custkey % (o_orderkey % 8) end as parent",
        "cast(case when o_orderkey % 8 = 0 then 0 else o_custkey % 8 end as int) as class_id", "case when o_orderkey % 2 = 0 then 'a' else 'b' end as anomer",
        "cast(case o_orderkey % 4 when 0 then 2 when 1 then 3 when 2 then 4 else 6 end as int) as parent_pos",
    )


def dim_symbol(spark: SparkSession) -> DataFrame:
    """The eight symbols by class; a fixed table."""
    return F.broadcast(spark.createDataFrame(list(enumerate(SYMBOLS)), "class_id int, symbol string"))
