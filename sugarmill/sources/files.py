"""Folders of label, log and image files: listed by type, read as lines or as decoded pictures, and written."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sugarmill.functions.lineage import shared_dir

#: Files that one task opens, and lines that it hands on at once.
FILES, LINES = 5_000, 10_000


def opened(where: str):
    """The file system of a path or URI, and the folder there."""
    from pyarrow import fs

    where = where.removeprefix("file:") if where.startswith("file:/") else where
    return fs.FileSystem.from_uri(re.sub("^/+", "/", where) if where.startswith("/") else where)


def listed(spark: SparkSession, path: str, types: tuple[str, ...], deep: bool) -> DataFrame:
    """(path, name, length, modified) of the files below a folder whose names end in one of ``types``; all without any.

    Tasks list the folders, those of one depth in one round, and write what they find to the shared folder, so that the driver holds
    neither files nor folders. One task lists a folder, so many files belong in many folders.
    """
    scheme = re.match(r"([a-z0-9]+):", path)
    prefix = "file:" if not scheme or scheme[1] == "file" else f"{scheme[1]}://"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for where in batch.column(0).to_pylist():
                store, folder = opened(where)
                found = [f for f in store.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(("_", "."))]
                found = [f for f in found if f.type == fs.FileType.Directory or (f.size and (not types or f.base_name.endswith(tuple(f".{t}" for t in types))))]
                columns = [[f"{prefix}{f.path}" for f in found], [f.base_name for f in found], [f.size for f in found], [f.mtime for f in found], [f.type == fs.FileType.Directory for f in found]]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "name", "length", "modified", "folder"])

    base, rounds = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}", []
    folders = spark.createDataFrame([(path,)], "path string")
    while True:
        rounds.append(f"{base}/{len(rounds)}")
        folders.mapInArrow(run, "path string, name string, length long, modified timestamp, folder boolean").write.parquet(rounds[-1])
        folders = spark.read.parquet(rounds[-1]).filter("folder").select("path").repartition(4 * spark.sparkContext.defaultParallelism)
        if not deep or folders.isEmpty():
            return spark.read.parquet(*rounds).filter("not folder").drop("folder")


def each_file(spark: SparkSession, path: str, types: tuple[str, ...], deep: bool, read: Callable[[pa.NativeFile], Iterator], kind: pa.DataType, schema: str) -> DataFrame:
    """(name, value): what ``read`` makes of each file, opened by tasks of a bounded number of files."""
    found = listed(spark, path, types, deep).select("path", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = [], []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, kind)], names=["name", "value"])
        store = None
        for batch in batches:
            for where, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if store is None:
                    store, _ = opened(where)
                with store.open_input_stream(where.removeprefix("file:").split("://")[-1]) as stream:
                    for value in read(stream):
                        names.append(name)
                        values.append(value)
                        if len(names) == LINES:
                            yield flush()
                            names, values = [], []
        yield flush()

    tasks = max(spark.sparkContext.defaultParallelism, -(-found.count() // FILES))
    return found.repartition(tasks, "path").mapInArrow(run, f"name string, value {schema}")


def folder_files(spark: SparkSession, path: str, *types: str) -> DataFrame:
    """(path, stem, type, n_bytes, modified) of every file under a folder whose name ends in one of ``types``; all files without any.

    Names are sorted out while the folder is listed, and no content is read. The stem ends before the name's first dot, the type begins
    behind its last one and is empty where there is none. Empty files and names that begin with ``_`` or ``.`` are left out, as Spark's own readers do.
    """
    name = F.col("name")
    kind = F.when(name.contains("."), F.element_at(F.split(name, "\\."), -1)).otherwise("")
    return listed(spark, path, types, True).select("path", F.split(name, "\\.")[0].alias("stem"), kind.alias("type"), F.col("length").alias("n_bytes"), "modified")


def folder_lines(spark: SparkSession, path: str, *types: str, deep: bool = False) -> DataFrame:
    """(stem, value): the lines of a folder's files of these types, each with its file's name up to the first dot; with ``deep`` those of its folders too."""

    def lines(stream: pa.NativeFile) -> Iterator[str]:
        for line in io.TextIOWrapper(stream, "utf-8", errors="replace", newline=None):
            yield line.removesuffix("\n")

    return each_file(spark, path, types, deep, lines, pa.string(), "string").select(F.split("name", "\\.")[0].alias("stem"), "value")


def folder_contents(spark: SparkSession, path: str, *types: str, deep: bool = False) -> DataFrame:
    """(stem, content): the bytes of a folder's files of these types; with ``deep`` those of its folders too."""
    rows = each_file(spark, path, types, deep, lambda stream: iter([stream.read()]), pa.binary(), "binary")
    return rows.select(F.split("name", "\\.")[0].alias("stem"), F.col("value").alias("content"))


def folder_pictures(spark: SparkSession, path: str, *types: str) -> DataFrame:
    """(stem, origin, height, width, channels, data) of a folder's files of these types, as Spark's image source reads them (PNG, JPEG, BMP, GIF).

    Data are lines of pixels from the top, a pixel's bytes blue, green, red. A file that is no picture has height and width -1 and empty data.
    """
    rows = spark.read.format("image").option("pathGlobFilter", f"*.{{{','.join(types)}}}").load(path)
    stem = F.split(F.element_at(F.split("image.origin", "/"), -1), "\\.")[0].alias("stem")
    return rows.select(stem, "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """A file of its own in the folder ``path`` for each row, from a column of names and one of bytes or text; null is an empty file.

    Each task writes its own rows' files under hidden names and moves them, so that a task that is run again leaves whole files. Names must
    be distinct; of two rows with one name either stays. A name may begin with folders, as in ``12/a.txt``. ``path`` is a folder that all
    executors share, as a path or a URI.
    """

    def run(part: Iterator[Row]) -> None:
        store, folder = opened(path)
        there = set()
        for r in part:
            target = f"{folder}/{r[0]}"
            into = target.rpartition("/")[0]
            if into not in there:
                store.create_dir(into, recursive=True)
                there.add(into)
            hidden = f"{into}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(bytes(r[1] or b""))
            store.move(hidden, target)

    rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).foreachPartition(run)
