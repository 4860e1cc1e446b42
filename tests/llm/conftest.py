import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, other columns whose names clash."""
    random.seed(5)
    prose = " ".join(f"word{random.randint(0, 10**6)}" for _ in range(300))
    rows = [
        (1, prose, "en", 1, "x"), (2, prose, "en", 1, "x"), (2, prose, "en", 1, "x"), (3, None, None, None, None), (4, "", "fr", 2, None), (None, prose[:400], "de", None, "y"),
        (None, None, None, None, None), (5, " \t\n ", "en", 3, "z"), (6, "x" * 300_000, "en", 4, "z"), (7, "ab " * 60_000, "de", 5, "z"), (8, "ünï ©中\U0001f600 " * 50, "de", 6, "z"), (9, "one", "es", 7, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, ids string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
