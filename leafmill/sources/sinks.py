"""Sinks: texts by stage and source, the best of them, one Markdown file for each book."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.store import file_name, write_file

#: Fixed value: what is written for recognised text where a file that needs it gave none.
EMPTY_OCR = "# OCR Processing Failed\n\nNo OCR results available."


def raw_rows(extracted: DataFrame) -> DataFrame:
    """config_key, source, text: embedded text always, recognised text where there is some; where there is none, a fixed text
    says so for files that needed both. extracted: config_key, text, ocr_text, file_type."""
    some = F.btrim(F.coalesce("ocr_text", F.lit("")), F.lit(" \t\r\n")) != ""
    ocr = F.when(some, F.col("ocr_text")).when(F.col("file_type") == "pdf-text-ocr", EMPTY_OCR)
    both = F.array(F.struct(F.lit("txt").alias("source"), F.coalesce("text", F.lit("")).alias("text")), F.struct(F.lit("ocr").alias("source"), ocr.alias("text")))
    return extracted.select("config_key", F.inline(both)).where(F.col("text").isNotNull())


def write_raw(extracted: DataFrame, folder: str) -> None:
    raw_rows(extracted).write.mode("overwrite").partitionBy("source").parquet(f"{folder}/stage=raw")


def write_cleaned(texts: DataFrame, folder: str) -> None:
    texts.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/stage=cleaned")


def best_text(keys: DataFrame, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """config_key, text: cleaned before raw, recognised before embedded, the first that is there. One aggregation over the
    texts instead of four joins."""
    ranked = cleaned.select("config_key", "text", F.when(F.col("source") == "ocr", 0).otherwise(1).alias("rank")).unionByName(raw.select("config_key", "text", F.when(F.col("source") == "ocr", 2).otherwise(3).alias("rank")))
    best = ranked.where(F.col("text").isNotNull()).groupBy("config_key").agg(F.min_by("text", "rank").alias("text"))
    return keys.join(best, "config_key", "left")


def write_markdown(books: DataFrame, folder: str) -> DataFrame:
    """Write ``<name>.md`` for each row of (name, text) and return name and path. A file gets its name only when whole, so a
    task that runs twice leaves one. The folder is a URI that executors share (file, hdfs, s3, gs). Separators in a name are underscores, and a
    missing name is one; of rows with equal names any one's text stays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for p in parts:
            paths = []
            for name, text in zip(p["name"], p["text"], strict=True):
                path = f"{base}/{file_name(name)}.md"
                write_file(store, path, (text or "").encode())
                paths.append(path)
            yield pd.DataFrame({"name": p["name"], "path": paths})

    return books.select("name", "text").mapInPandas(run, "name string, path string")


def page_json(pages: DataFrame) -> DataFrame:
    """book_id, page_no and the page's paragraphs as JSON."""
    return pages.select("book_id", "page_no", F.to_json("paragraphs").alias("json"))
