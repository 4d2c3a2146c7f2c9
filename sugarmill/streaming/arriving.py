"""Detections that arrive as files: an image's network rows become its kept boxes, and counts in event-time windows, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarmill.operators import detections


def windowed(stream: DataFrame, time: str, kind: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by kind and window of event time; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def counted(spark: SparkSession, events: DataFrame, time: str, kind: str, folder: str) -> DataFrame:
    """Writes the rows to a shared folder, streams them file by file, and returns the counts of all windows.

    Each batch writes the windows as they stand; the folder also holds the stream's checkpoint.
    """
    events.select(time, kind).write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.select(time, kind).schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    counts = windowed(stream, time, kind, late="3650 days")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def decoded_once(images: DataFrame, image: str, time: str, late: str, whitespace: int, padding: float) -> DataFrame:
    """(image, det_id, boxes, conf) rows of a stream of images with their network ``rows``; an image that comes again within ``late`` of
    the newest event is dropped, as is one that comes later than that. The state is the ids of the images of that time."""
    once = images.withWatermark(time, late).dropDuplicatesWithinWatermark([image])
    rows = once.select(image, F.explode("rows").alias("r")).select(image, "r.*")
    return detections.decode(detections.arg_max(rows), whitespace, padding)


def suppressed(spark: SparkSession, inbox: str, schema, folder: str, image: str = "image_id", time: str = "ts", late: str = "1 day", threshold: float = 0.3, limit: float = 0.4, whitespace: int = 200, padding: float = 0.0, files: int = 4) -> DataFrame:
    """Reads all files that now lie in ``inbox`` and were not read before, and returns the kept detections of all images so far.

    A record is an image with all its network rows, so an image is never split over batches: the rows are decoded without state, and each batch is
    suppressed per image as a table. A batch overwrites its own part of ``folder``, and the stream's checkpoint is there too, so
    a run that stops and starts again gives each image once. Images without rows, or with null rows, keep nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(inbox)

    def keep(batch: DataFrame, number: int) -> None:
        detections.non_max_suppression(batch, threshold, limit, image).write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")

    decoded = decoded_once(stream, image, time, late, whitespace, padding)
    q = decoded.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = f"{image} {dict(spark.createDataFrame([], schema).dtypes)[image]}, det_id long, x int, y int, w int, h int, conf double, batch int"
    return spark.read.schema(columns).parquet(f"{folder}/kept").drop("batch")
