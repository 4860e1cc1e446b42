"""Configuration of books: defaults, then what their kind says, then what the book itself says.

A layer is a table with a key and any of the option columns; null says nothing. All books, whatever they say, go through one plan: options
are columns of their rows.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.lines import CleanOptions, RowOptions
from leafmill.operators.clean import clean_text

TYPES = {"aggressive": "boolean", "remove_boilerplate": "boolean", "remove_urls": "boolean", "remove_toc": "boolean", "extra_patterns": "array<string>", "source": "string"}


def configured(docs: DataFrame, *layers: tuple[DataFrame, str], defaults: CleanOptions = CleanOptions()) -> DataFrame:
    """docs with a struct column ``options``. layers: (table, key) from the most general to the most particular; a key is a column of
    both sides, each value once in its table. Tables are small next to texts, so Spark broadcasts them while their size allows it."""
    found: dict[str, list] = {f.name: [] for f in fields(defaults)}
    out = docs
    for i, (layer, key) in enumerate(layers):
        said = [c for c in found if c in layer.columns]
        out = out.join(layer.select(key, *(F.col(c).cast(TYPES[c]).alias(f"_{i}_{c}") for c in said)), key, "left")
        for c in said:
            found[c].insert(0, F.col(f"_{i}_{c}"))
    value = {c: F.array(*map(F.lit, v)).cast(TYPES[c]) if isinstance(v := getattr(defaults, c), tuple) else F.lit(v) for c in found}
    return out.select(*docs.columns, F.struct(*(F.coalesce(*found[c], value[c]).alias(c) for c in found)).alias("options"))


def clean_configured(docs: DataFrame, text: str = "text") -> DataFrame:
    """clean_text of documents by their own ``options`` (of configured)."""
    return clean_text(docs, RowOptions.of(F.col("options")), text)
