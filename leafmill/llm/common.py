"""What the training-data operators share: the shared folder, staged tables, file access."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Reserved key under which rows without a key are filed.
NULL_KEY = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of our own; on a cluster no folder can be guessed, and that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"leafmill-{os.getuid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders of the runs that are open, by session: what is staged meanwhile lies in the innermost one.
_RUNS: dict[int, list[str]] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name below the open run's folder, else below the shared one, as a full URI."""
    open_runs = _RUNS.get(id(spark))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{open_runs[-1] if open_runs else f'{shared_dir(spark)}/leafmill'}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


@contextlib.contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder for all that is staged within the block, deleted at its end. Results are lazy: write them to a folder made
    before the block, or use them up within it."""
    path = workspace(spark, name)
    _RUNS.setdefault(id(spark), []).append(path)
    try:
        yield path
    finally:
        _RUNS[id(spark)].pop()
        drop(spark, path)


def put(fs, tmp: str, final: str) -> None:
    """Give a whole file its name. A second attempt of a task finds it there, whole and the same, and leaves it."""
    from pyarrow.fs import FileType

    if fs.get_file_info(final).type == FileType.File:
        fs.delete_file(tmp)
        return
    try:
        fs.move(tmp, final)
    except OSError:
        if fs.get_file_info(final).type != FileType.File:
            raise
        fs.delete_file(tmp)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation of what came before. Returns the table and its path."""
    spark, path = df.sparkSession, workspace(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete staged folders through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(uri: str):
    """pyarrow file system and path of a URI, also on executors (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    elif "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


#: Rows that go to Python in one Arrow batch, where the session doesn't say: texts are long.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session has a size of its own. Both ends of the pipe hold a batch,
    so Spark's default of 10,000 rows is tens of megabytes of ordinary documents."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def release_memory() -> None:
    """Give freed memory back to the system: workers are used again by later tasks and stages, and what
    one of them has freed the others can't use."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values; another seed, another permutation."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df
