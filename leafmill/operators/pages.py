"""Which pages of a book are its content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import contains_marker


def page_range(pages: DataFrame, book: str, page: str, skip_start: bool = False, raw: bool = False) -> DataFrame:
    """Pages after the first that has ``start_marker`` and before the next that has ``end_marker``.

    pages: the key columns, text, start_marker, end_marker. No page with the start marker: no pages. skip_start: all pages from the
    first on, which may have the end marker itself. raw: markers are compared as they are, else normalised. One window over
    each book's pages."""
    has = (lambda t, m: F.coalesce((m != "") & F.contains(t, m), F.lit(False))) if raw else contains_marker
    flagged = pages.withColumn("_s", has(F.col("text"), F.col("start_marker"))).withColumn("_e", has(F.col("text"), F.col("end_marker")))
    w = Window.partitionBy(book)
    start = F.lit(None).cast("long") if skip_start else F.min(F.when(F.col("_s"), F.col(page))).over(w)
    out = flagged.withColumn("_start", start)
    after = F.lit(True) if skip_start else F.col(page) > F.col("_start")
    out = out.withColumn("_end", F.min(F.when(F.col("_e") & after, F.col(page))).over(w))
    return out.where(after & (F.col("_end").isNull() | (F.col(page) < F.col("_end")))).drop("_s", "_e", "_start", "_end")
