"""Sources: whole text files, bytes and their heads, PDF text by the caller's extractor, results that are kept from scan to scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.files import base_name, extension, mime_type
from leafmill.sources import store

HEAD = 1024
#: Fixed value: what stands for an EPUB's text, around the file's name.
EPUB_TEXT = ("[EPUB Content from ", "]\n\nThis is placeholder EPUB text.")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file, decoded as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modified, length, content; content is read only where it is used."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def headers(files: DataFrame) -> DataFrame:
    """The first 1024 bytes of each file."""
    return files.select("path", "length", F.substring("content", 1, HEAD).alias("content"))


def pdf_text(files: DataFrame, extract: Callable[..., tuple[int, str]], pages: int | None = None) -> DataFrame:
    """path, page_count, text by an extractor that the caller brings (none is installed): ``extract(content)``, or with ``pages``
    ``extract(content, pages)``, which counts all pages and gives the text of the first ones. A file that it fails on has null
    text and its error in ``issue``."""
    more = () if pages is None else (pages,)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    rows.append((path, *extract(bytes(content), *more), None))
                except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_count", "text", "issue"])

    return files.select("path", "content").mapInPandas(run, "path string, page_count int, text string, issue string")


def epub_text(files: DataFrame) -> DataFrame:
    """A fixed text: the content of EPUB files isn't read."""
    return files.select("path", F.concat(F.lit(EPUB_TEXT[0]), base_name(F.col("path")), F.lit(EPUB_TEXT[1])).alias("text"))


def file_info(files: DataFrame) -> DataFrame:
    """path, name, length, format (null where the extension is unknown) and mime type of each file."""
    e = extension(F.col("path"))
    fmt = F.when(e == ".pdf", "pdf").when(e == ".epub", "epub").when(e == ".txt", "txt")
    return files.select("path", base_name(F.col("path")).alias("name"), "length", fmt.alias("format"), F.when(fmt.isNotNull(), mime_type(fmt)).alias("mime"))


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recognised pages as Parquet or JSON rows (book_id, page_no, paragraphs or lines)."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def with_cache(new: DataFrame, cached: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from earlier results where they have it. Both sides are dealt by key unless Spark finds one small."""
    old = cached.select(key, F.col(column).alias("_old"))
    return new.join(old, key, "left").withColumn(column, F.coalesce("_old", column)).drop("_old")


# -- results kept from scan to scan -----------------------------------------------------------

STATE = "path string, modified timestamp, length long"


def incremental(spark: SparkSession, folder: str, state: str, compute: Callable[[DataFrame], DataFrame], result: str, glob: str | None = None) -> tuple[DataFrame, int]:
    """path, modified, length and the columns of ``result`` (a schema) of all files in ``folder``, and how many were read.

    compute: from rows of binary_files to path and the columns of ``result``. A file whose path, length and time of change are those of
    the last scan keeps its result and isn't opened: only names, lengths and times are listed, and content is loaded for the others alone
    (their names pass through the driver, as every listing of Spark's does). ``state`` is a folder that all executors share; each scan writes a
    version of its own there, whole or not at all, and the one before goes when it is there. Files that are gone are gone from it."""
    listed = binary_files(spark, folder, glob).select("path", "modified", "length")
    columns = [c.split()[0] for c in result.split(", ")]
    done = [int(n[1:]) for n in store.children(spark, state) if n[1:].isdigit() and store.exists(spark, f"{state}/{n}/_SUCCESS")]
    before = spark.read.schema(f"{STATE}, {result}").parquet(f"{state}/v{max(done)}") if done else spark.createDataFrame([], f"{STATE}, {result}")
    key = ["path", "modified", "length"]
    kept = listed.join(before, key)
    changed = [r.path for r in listed.join(before, key, "left_anti").select("path").toLocalIterator()]
    if changed:
        fresh = spark.read.format("binaryFile").load([_escaped(p) for p in changed]).select("path", F.col("modificationTime").alias("modified"), "length", "content")
        found = fresh.drop("content").join(compute(fresh).select("path", *columns), "path", "left")
        kept = kept.unionByName(found.select(*key, *columns))
    elif done and before.count() == listed.count():
        return before, 0
    now = f"{state}/v{max(done, default=0) + 1}"
    kept.select(*key, *columns).write.mode("overwrite").parquet(now)
    for n in done:
        store.delete(spark, f"{state}/v{n}")
    return spark.read.schema(f"{STATE}, {result}").parquet(now), len(changed)


def _escaped(path: str) -> str:
    """A path of one file: signs that would make it a pattern stand for themselves."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def page_counts(spark: SparkSession, folder: str, state: str, extract: Callable[..., tuple[int, str]]) -> tuple[DataFrame, int]:
    """page_count of each file, counted again only where it changed: 0 of other files than PDFs and of those that can't be read."""

    def count(files: DataFrame) -> DataFrame:
        pdf = extension(F.col("path")) == ".pdf"
        found = pdf_text(files.where(pdf), extract, 0).select("path", F.coalesce("page_count", F.lit(0)).alias("page_count"))
        return found.unionByName(files.where(~pdf).select("path", F.lit(0).alias("page_count")))

    return incremental(spark, folder, state, count, "page_count int")
