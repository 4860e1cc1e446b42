"""Files in folders that executors share: written by tasks that may run twice, asked for and deleted by the driver."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def file_name(name: str | None) -> str:
    """A name that is one file's and stays in its folder: separators and leading dots go, and no name is ``_``."""
    return re.sub(r"[/\\\0]", "_", name or "").lstrip(".") or "_"


def write_file(store, final: str, content: bytes) -> bool:
    """Write a whole file under its name, over an older one. A second attempt of a task finds the same bytes and leaves them.
    store: a pyarrow file system. Returns whether anything was written."""
    from pyarrow.fs import FileType

    def there() -> bool:
        info = store.get_file_info(final)
        if info.type != FileType.File or info.size != len(content):
            return False
        with store.open_input_stream(final) as f:
            return f.read() == content

    if there():
        return False
    tmp = f"{final.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as out:
        out.write(content)
    for last in (False, True):
        try:
            store.move(tmp, final)
            return True
        except OSError:  # some stores move over no file: an older one goes, one of another attempt is the same
            if there():
                store.delete_file(tmp)
                return False
            if last:
                raise
            if store.get_file_info(final).type == FileType.File:
                store.delete_file(final)
    return True


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, uri: str) -> str:
    """A URI with its scheme and whole path."""
    path, fs = _path(spark, uri)
    return fs.makeQualified(path).toString()


def exists(spark: SparkSession, uri: str) -> bool:
    path, fs = _path(spark, uri)
    return fs.exists(path)


def delete(spark: SparkSession, uri: str) -> bool:
    """Delete a folder or file; False if there was none."""
    path, fs = _path(spark, uri)
    return fs.delete(path, True)


def children(spark: SparkSession, uri: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    path, fs = _path(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, uri: str) -> str | None:
    """A small file's text, or None where there is none."""
    path, fs = _path(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """Write a small file as a whole: under another name first, which then takes the older one's place."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(uri)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)
    fs = path.getFileSystem(conf)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{uri}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, path, over)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder name that the driver and all executors see: below ``spark.checkpoint.dir``, or on a local master without that setting
    below a folder of our own."""
    import getpass
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/leafmill-{getpass.getuser()}"
    return qualified(spark, f"{base.rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}")
