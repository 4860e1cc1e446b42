"""Steps do no more than they must, and give what the plain way gives."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.functions import lines as L
from leafmill.functions import patterns as P
from leafmill.functions import text as T
from leafmill.operators import clean as C
from leafmill.operators import ocr, repeats
from leafmill.plans.queries import QUERIES


def test_unusual_characters(spark):
    """All characters that normalisation changes are looked for, by few ranges; lines are those of the normalised text."""
    every = [*P.QUOTES, *P.SPACES, *P.CONTROL, *P.DELETED, *P.LIGATURES, *P.WIDE]
    assert len(T.UNUSUAL.split("-")) <= 8 and all(re.search(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.UNUSUAL), c) for c in every)
    rows = [(f"a{c}b\nplain \u00e9\f{c}",) for c in every] + [("",), ("\f",)]
    text = F.col("text")
    assert not spark.createDataFrame(rows, "text string").where(~C.normal_lines(text).eqNullSafe(C.split_lines(T.normalize_unicode(text)))).count()


def test_signature_with_other_spaces(spark):
    """A section is found by the normalised line."""
    lines = ["x", P.SIGNATURE[4:].replace(" ", "\u00a0"), "row", "The user has requested enhancement", "y"]
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    assert C.line_table(docs).select("_doc.sections", "_doc.lines").first() == (1, ["x", "y"])


def test_words_of_long_lines(spark):
    """Runs of letters are met once, whatever the line is like."""
    lines = ["", "abc", "ab cd", "abc def", "abcdef", "abc1def2ghi", "ab-abc-ab-abc", "#" * 50_000 + "abc", "a" * 50_000, "ab " * 20_000, "abc", "\u00e9abc\u00e9de fgh"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", *(F.regexp_like("x", F.lit(P.words(n))).alias(f"w{n}") for n in (2, 3))).collect()
    assert [(r.w2, r.w3) for r in got] == [(n >= 2, n >= 3) for n in (len(re.findall("[A-Za-z]{3,}", x)) for x in lines)]


def test_umlauts_by_needed_letters(spark):
    """Every step is tried where its letters are, in either case, and in the order of the list."""
    words = [re.sub(r"\(\?=.*|\\b|\[|0\]", "", p).replace("([a-zA-Z]+)", "x") for p, _ in P.UMLAUTS + P.UMLAUTS_INSIDE]
    text = " ".join(words) + " ".join(w.upper() for w in words) + " Er0ffnung langer werden"
    step = lambda p, i: (f"(?i){P.java_words(p)}" if i else P.java_words(p))
    plain, n = F.col("t"), F.lit(0)
    for i, steps in ((True, P.UMLAUTS), (False, P.UMLAUTS_INSIDE)):
        for p, new in steps:
            plain, n = F.regexp_replace(plain, step(p, i), new), n + F.regexp_count("t", F.lit(step(p, i)))
    rows = spark.createDataFrame([(text,), ("none",), ("",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(T.fix_umlauts(F.col("t")), T.count_umlauts(F.col("t"))).collect()] == [tuple(r) for r in rows.select(plain, n.cast("long")).collect()]


def test_slice_composes_the_text_once(spark):
    docs = spark.createDataFrame([("a \u2003 e\u0301 b\u2000c", "e\u0301", "c"), ("x  y", "", ""), (None, "a", "b")], "t string, b string, a string")
    out = docs.select(T.boundary_slice(F.col("t"), F.col("b"), F.col("a")).alias("x"))
    assert [r.x for r in out.collect()] == [" b\u2002", "x y", None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("2,}") <= 2


def test_few_pages_are_objects(spark, monkeypatch):
    """A batch of many pages is read in slices."""
    sizes, plain = [], pa.RecordBatch.to_pylist
    line = {"text": "x", "x0": 300.0, "x1": 900.0, "y0": 0.0, "y1": 40.0, "symbols": None}

    class Pages:
        schema = spark.createDataFrame([], "book_id long").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pylist([{"book_id": i % 3, "page_no": i, "lines": [line] if i else None} for i in range(1000)])

            class Counted:
                schema, num_rows = batch.schema, batch.num_rows

                def slice(self, at, n):
                    sizes.append(n)
                    return batch.slice(at, n)

            return [r for b in run([Counted()]) for r in plain(b)]

    rows = ocr.structure_pages(Pages(), [], {})
    assert max(sizes) <= ocr.SLICE and [(r["page_no"], r["body"]) for r in rows] == [(i, "x" if i else "") for i in range(1000)]


def test_junk_by_rows(spark):
    rows = spark.createDataFrame([("#%&^^~~++==",), ("abc" + "#" * 40 + "def",), ("plain words stand here",)], "x string")
    got = rows.select(*(L.is_ocr_junk(F.col("x"), o) for o in (False, True, F.lit(True)))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, True), (False, False, False)]


def test_work_is_behind_the_exchange(spark, sf):
    """Documents are dealt by their id as they are read: one exchange, and below it the scan alone."""
    for name in ("rewrap", "clean_text_aggressive", "boundary_slice"):
        run = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert run.count("Exchange hashpartitioning(doc_id") == run.count("Exchange ") == 1, name
        below = run.split("Exchange hashpartitioning(doc_id")[1]
        assert "Generate" not in below and "ArrowEvalPython" not in below and "Aggregate" not in below, name


def test_plain_lines_have_no_reason(spark):
    """One pattern tells prose: every line that it passes has no reason, and none of those that a pattern is about is passed."""
    words = ["plain words stand here", "Über alle Berge und", "a b c d e", "one two three 7", "x·y"]
    marked = ["Not for distribution", "For internal use", "internal use only", "proprietary and confidential", "All rights reserved.", "Copyright by somebody, 2024 and on", "Printed in some far land", "Available online 3 May", "Received some time, Accepted later on",
              "Contents lists available at some place", "journal homepage: some where or other", "Elsevier B.V.", "doi: some where or other", "draft", "ISBN 978", "see profile", "Alle Rechte vorbehalten", "do not distribute", "Jane Doe · 2020", "two words here © 2020 x",
              "words then View publication stats here", "the big old House University", "it was uploaded by me on May 2020 then", "read Academia.edu for more words", "my old paper View project here", "https://example.org/some/long/path", "www.example.org/abc/def/ghi", "someone@example.org.abc.def"]
    junk = ["#%&^^~~++==", "a b c d e f", "w i t h a r e", "Some old title ..... 12", "Some old title ___ 7 ", "[12]", "3.", "", "  ", "page 3 of 10"]
    rows = [(a + x,) for x in words + marked + junk for a in ("", "  ", "\x0b", "é")] + [(x + b,) for x in words + marked + junk for b in (" and more words to it", " 12", "\t", "\x0b", ".")] + [(x.upper(),) for x in marked]
    docs, line, low = spark.createDataFrame(rows, "x string"), F.col("x"), F.lower("x")
    for ocr in (False, True):
        why = lambda plain: L.drop_reason(line, F.lit(""), F.lit(""), plain, F.lit(False), F.lit(False), L.CleanOptions(source="ocr" if ocr else "pdf"))  # noqa: B023, E731
        plain = L.is_plain(T.trim(line), low, L.marks_of(low))
        got = docs.select("x", plain.alias("plain"), why(F.lit(False)).alias("long"), why(plain).alias("short")).collect()
        assert not [r for r in got if r.long != r.short]
        assert sum(r.plain for r in got) > 20 and all(r.plain for r in got if r.x in ("plain words stand here", "Über alle Berge und"))


def test_few_lines_are_compared(monkeypatch):
    """Of a few lines of about one length only those that may be alike are compared pair by pair; the index gives the same."""
    calls, plain = [], repeats.dice
    monkeypatch.setattr(repeats, "dice", lambda a, b: calls.append(1) or plain(a, b))
    r = random.Random(3)
    prose = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(5)) for _ in range(20)) for _ in range(30)]
    lines = prose + [prose[0][:-1] + "x", prose[0][:-1] + "y"]
    few = repeats.fuzzy_repeats(lines, 3)
    assert few == [i in (0, 30, 31) for i in range(32)] and len(calls) < 20
    monkeypatch.setattr(repeats, "FEW", 0)
    assert repeats.fuzzy_repeats(lines, 3) == few


def test_repeats_are_searched_before_they_are_judged(spark):
    lines = ["Running header of a document"] * 3 + ["1234567890123456789012345678"] * 3 + ["12,345 67,890 12,345 67,890 1"] * 3 + ["short"] * 9 + ["Running header that is alone"]
    got = spark.createDataFrame([(lines,)], "x array<string>").select(C.repeated_lines(F.col("x"), F.lit(3)).alias("r")).first()
    assert got.r == ["Running header of a document"]


def test_white_space_runs_of_texts(spark):
    """What is passed over first is no white space."""
    every = "".join(map(chr, [*range(1, 0x300), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF]))
    text = "".join(f"a{c}{c}b{c}c" for c in every)
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    assert not df.where(~T.collapse_whitespace(F.col("t")).eqNullSafe(F.regexp_replace("t", P.JS_SPACE + "{2,}", " "))).count()
