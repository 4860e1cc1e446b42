"""Column functions over recognised pages and assembled books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import trim

FOOTNOTES = "# FUSSNOTEN"
SMALL, RAISED = 0.7, 5


def flatten_lines(paragraphs: Column) -> Column:
    """Lines of all paragraphs, in order."""
    return F.flatten(F.transform(paragraphs, lambda p: p["lines"]))


def superscript_start(symbols: Column, height: Column) -> Column:
    """Digits or asterisks that begin a line, small and above the base line; null if there are none.

    symbols: of the line's first word, with text, y0, y1 and base_y1 (null where it has no base line)."""
    fits = lambda s: (s["y1"] - s["y0"] < height * SMALL) & F.coalesce(s["y1"] < s["base_y1"] - RAISED, F.lit(False)) & F.regexp_like(s["text"], F.lit(r"^(\d+|\*+)\z"))
    good = F.transform(symbols, fits)
    n = F.coalesce(F.nullif(F.array_position(good, F.lit(False)), F.lit(0).cast("long")) - 1, F.size(symbols).cast("long"))
    joined = F.array_join(F.transform(F.slice(symbols, F.lit(1), n.cast("int")), lambda s: s["text"]), "")
    return F.when(F.size(symbols) > 0, F.when(joined != "", joined))


def line_type(x0: Column, footnote: Column, metrics: Column) -> Column:
    """A footnote's start, else the first of the page's ranges that has x0, else paragraph text."""
    found = F.get(F.filter(metrics, lambda m: (x0 >= m["min_x0"]) & (x0 <= m["max_x0"])), 0)["type"]
    return F.when(footnote.isNotNull(), "footnote-start").otherwise(F.coalesce(found, F.lit("paragraph-text")))


def footnote_line(text: Column) -> Column:
    """``[^n]: text`` of a line that begins with its number or asterisks, else null."""
    pattern = r"^(\d+|[*]+)\s*([^\n\r]+)\z"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.concat(F.lit("[^"), F.regexp_extract(text, pattern, 1), F.lit("]: "), F.regexp_extract(text, pattern, 2)))


def outline(text: Column) -> Column:
    """Headings, and the first five words of every other line, of what comes before the footnotes."""
    head = F.get(F.split(text, FOOTNOTES), 0)
    body = F.when(head != "", head).otherwise(text)
    lines = F.filter(F.transform(F.split(body, "\n"), trim), lambda x: x != "")
    return F.transform(lines, lambda x: F.when(x.startswith("#"), x).otherwise(F.array_join(F.slice(F.split(x, r"\s+"), 1, 5), " ")))


def footnote_list(text: Column) -> Column:
    """Footnotes without their marks of origin."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: (x != "") & (x != FOOTNOTES))
    return F.filter(F.transform(lines, lambda x: trim(F.regexp_replace(x, r"^\[[MT]\]\s*", ""))), lambda x: x != "")


def needs_recognition(fmt: Column) -> Column:
    """Whether a format may hold images of text."""
    return F.lower(fmt).isin("pdf", "png", "jpg", "jpeg", "tiff", "bmp")


