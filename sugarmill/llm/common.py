"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python task holds as Python objects at once.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where unset (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to is None:
        set_to = spark.sparkContext.getCheckpointDir()
    if set_to is None:
        set_to = tempfile.mkdtemp(prefix="sugarmill-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


#: Rows that go to or from a Python worker at once while a table is written.
BATCH = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths that written() has made, one list for each open collected().
_COLLECTING: list[list[str]] = []


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Python workers get few rows at once; the session's own setting comes back after."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors. Files of very wide
    rows have few of them each, as a reader takes thousands of a file's rows at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    for paths in _COLLECTING:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files of written()."""
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, [t.written_path])


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that written() makes within."""
    paths: list[str] = []
    _COLLECTING.append(paths)
    try:
        yield paths
    finally:
        _COLLECTING.remove(paths)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, which Spark clears once nothing refers to it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with an underscore after it for as long as ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that only a piece becomes Python objects. At the end, unused memory goes back
    to the machine: a Python worker outlives its task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    tidy()


def tidy() -> None:
    """Gives memory that is not in use back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
