"""Folds over columns against sequential models: fuzzy groups, edges, assembly, headings."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.functions.headings import heading_captures, heading_level, match_heading
from leafmill.functions.layout import edge_metrics
from leafmill.functions.structure import FOOTNOTES
from leafmill.operators.ocr import assemble_books, join_pages, page_metrics
from leafmill.operators.repeats import dice, dice_similarity, fuzzy_repeats

# -- fuzzy repeats ------------------------------------------------------------------------------


def fuzzy_model(lines, threshold):
    """Every pair, leader by leader."""
    out, by_length = [False] * len(lines), defaultdict(list)
    for i, line in enumerate(lines):
        if len(t := line.strip(" \t\r\n")) >= 5:
            by_length[len(t) // 5].append((i, t))
    for rows in by_length.values():
        if len(rows) < threshold:
            continue
        free = [True] * len(rows)
        for k, (i, lead) in enumerate(rows):
            if free[k]:
                like = [m for m in range(k + 1, len(rows)) if free[m] and dice(lead, rows[m][1]) >= 0.85]
                for m in like:
                    free[m] = False
                if len(like) + 1 >= threshold:
                    for j in (i, *(rows[m][0] for m in like)):
                        out[j] = True
    return out


def test_fuzzy_model():
    found = 0
    for seed in range(300):
        r = random.Random(seed)
        base = ["".join(r.choice("abcde "[: r.randint(2, 6)]) for _ in range(r.randint(3, 45))) for _ in range(r.randint(1, 8))]
        lines = []
        for _ in range(r.randint(0, 50)):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = r.choice("abcxy")
            lines.append("".join(x[: -1 if r.random() < 0.3 else None]))
        threshold = r.randint(2, 4)
        want = fuzzy_model(lines, threshold)
        assert fuzzy_repeats(lines, threshold) == want
        found += sum(want)
    assert found > 1000


def test_fuzzy_is_fast():
    """2,000 lines of one length, all different or all alike."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400)]
    for lines in ([" ".join(r.choice(words) for _ in range(6))[:40].ljust(40, "x") for _ in range(2000)], [f"Running Header of Chapter {i:06d} and {i * 7919 % 9973:05d}" for i in range(2000)]):
        began = time.process_time()
        fuzzy_repeats(lines, 3)
        assert time.process_time() - began < 3


def test_dice_column(spark):
    r = random.Random(2)
    texts = ["", "a", "ab", "aaaa", "aaaaa", "Running Header 1", "Running Header 12", "Über 😀 x", "Über 😀 y"] + ["".join(r.choice("ab c") for _ in range(r.randint(0, 12))) for _ in range(40)]
    rows = [(a, b) for a in texts for b in texts]
    for r_ in spark.createDataFrame(rows, "a string, b string").select("a", "b", dice_similarity(F.col("a"), F.col("b")).alias("d")).collect():
        assert r_.d == dice(r_.a, r_.b), (r_.a, r_.b)


# -- assembly -----------------------------------------------------------------------------------


def test_assembly(spark):
    rng = random.Random(1)
    rows = []
    for b in range(200):
        for n in range(rng.randint(1, 14)):
            body = "".join(rng.choice(["a", "-", "--", " ", "\t", "B", "Word-", "end. ", "é", "\n", "É"]) for _ in range(rng.randint(0, 4)))
            rows.append((b, n, rng.choice([body, body, body, None]) if b % 9 == 0 else body, rng.choice(["", "\n\n[^1]: x", "y-", "Z"])))
    got = {r.book_id: r.text for r in assemble_books(spark.createDataFrame(rows, "book_id long, page_no int, body string, footnotes string").repartition(5)).collect()}
    for b in range(200):
        body, notes = "", f"\n\n{FOOTNOTES}"
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: r[1]):
            body, notes = join_pages(body, r[2] or ""), join_pages(notes, r[3])
        assert got[b] == body + notes


def test_long_book(spark):
    """10,000 pages in time that grows with their number; no Python in the plan."""

    def book(n):
        body = F.when(F.col("id") % 3 == 0, F.repeat(F.lit("word "), F.lit(200))).otherwise(F.lit("half-"))
        return assemble_books(spark.range(n).select(F.lit(1).cast("long").alias("book_id"), F.col("id").cast("int").alias("page_no"), body.alias("body"), F.lit("").alias("footnotes")))

    def took(n):
        began = time.monotonic()
        assert book(n).select(F.length("text")).first()[0] > 300 * n
        return time.monotonic() - began

    took(100)
    assert "Python" not in book(10)._jdf.queryExecution().executedPlan().toString() and took(40_000) < 12 * max(took(10_000), 0.5)


# -- edges --------------------------------------------------------------------------------------


@pytest.mark.parametrize("offsets", [{}, {"paragraph-start": 40, "footnote-start": {"expected_x0": 20, "tolerance": 5}, "quote-text": 200}, {"paragraph-start": {"expected_x0": 30}, "footnote-text": 33}])
def test_edges(spark, offsets):
    rng = random.Random(4)
    pages = []
    for p in range(150):
        edges = [float(rng.choice([300, 340, 320, 500, 360]) + rng.randint(-6, 9)) for _ in range(rng.randint(0, 30))]
        pages.append((p, [(x, x + rng.randint(10, 1800)) for x in edges]))
    table = spark.createDataFrame(pages, "page_no int, lines array<struct<x0:double,x1:double>>")
    for r in table.select("page_no", edge_metrics(F.col("lines"), offsets).alias("m")).collect():
        want = page_metrics([{"x0": a, "x1": b} for a, b in pages[r.page_no][1]], offsets)
        assert [m.type for m in r.m] == [m["type"] for m in want]
        for got, w in zip(r.m, want, strict=True):
            assert all(getattr(got, k) == pytest.approx(w[k]) for k in w if k != "type")


# -- headings -----------------------------------------------------------------------------------

TEMPLATES = [
    "{roman-number}", "{title-in-capital-letters}", "Kapitel {decimal-number}", "{german-ordinal} VORTRAG", "{place}, {long-date}", "{title-with-decimal-number}", "{no-paragraph-end-marker}",
    "{no-paragraph-end-marker} {decimal-number}", "{decimal-number} {decimal-number}", "a.b*c", "(x", "{title}", "{nothing}", "§ {decimal-number} {title}",
]
WORDS = ["XIV", "XCIX", "IC", "Kapitel", "7", "12", "erster", "VORTRAG", "Berlin", "Bad Homburg", "12. Mai 1910", "12. Maler", "EIN TITEL", "Ein Satz.", "ÄÖ «", "!", "a.b*c", "ein", "§", " ", "!»", ".»", "Straße,", "x-y", "{nothing}"]


def test_captures(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", ""]) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1).select("t", *(heading_captures(F.col("t"), x).alias(f"c{i}") for i, x in enumerate(TEMPLATES))).collect()
    hits = 0
    for r in rows:
        for i, template in enumerate(TEMPLATES):
            want = match_heading(r.t, template)
            hits += want is not None
            assert r[i + 1] == (None if want is None else {k: v for k, v in want.items() if k}), (r.t, template)
    assert hits > 300


def test_levels(spark):
    one = spark.createDataFrame([("XIV",), ("Kapitel 7",), ("text",), (None,)], "t string")
    got = [r.x for r in one.select(heading_level(F.col("t"), [["Kapitel {decimal-number}"], ["{roman-number}"]]).alias("x")).collect()]
    assert (got[0].level, got[0].template, got[0].values) == (2, "{roman-number}", {"roman-number": "XIV"}) and got[1].level == 1 and got[2:] == [None, None]
    assert one.select(heading_level(F.col("t"), []).alias("x")).first().x is None
