import random

import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.lines import COUNTERS, CleanOptions
from leafmill.operators.clean import clean_text
from leafmill.operators.repeats import dice, fuzzy_repeats


def cleaned(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.cleaned_text, r.stats.asDict(True)) for r in clean_text(rows, CleanOptions(**options)).orderBy("doc_id").collect()]


HEAD = "A running header of some length"
CASES = [
    ("ﬁne “words” — here", "fine \"words\" -- here"),
    ("a​b﻿c", "abc"),
    ("one two three", "one two three"),
    ("first\fsecond", "first second"),
    ("text.\n\n12\n\nMore.", "text.\n\n\nMore."),
    ("See Page 1 of the book.", "See Page 1 of the book."),
    ("Before.\n- 12 -\nAfter.", "Before.\nAfter."),
    ("Chapter one ..... 12\nChapter two ______ 30\nText.", "Text."),
    ("Text.\n[1]\nMore.", "Text.\nMore."),
    ("docu-\nmentation here", "documentation here"),
    ("a line that\ngoes on", "a line that goes on"),
    ("One.\n\nTwo.", "One.\n\nTwo."),
    ("© 2020 A\nAll rights reserved.\nISBN 978-3-16\nText.", "Text."),
    ("Text.\nw i t h a r e\nMore.", "Text.\nMore."),
    ("docu-\nmen-\ntation", "documen- tation"),
    ("— 12 —\n—", "-- 12 --\n--"),
    ("End,\nNext", "End, Next"),
    ("a\n\n\n\n\nB", "a\n\n\nB"),
    ("", ""),
    (None, ""),
    ("\n \n\t\n", ""),
    ("[1]\n•\n|", ""),
    ("© 2024 x\r\nkept\r\nISBN 1\r", "© 2024 x\nkept"),
]


def test_cases(spark):
    got = cleaned(spark, [c[0] for c in CASES])
    for (given_text, want), (text, stats) in zip(CASES[:-1], got[:-1], strict=True):
        assert text == want, given_text
        assert stats["final_lines"] == (len(want.split("\n")) if want else 0)
    # A pattern of any characters doesn't reach over a carriage return; one of white space does.
    assert "kept" in got[-1][0] and "ISBN" not in got[-1][0]


def test_repeated_header(spark):
    lines = [x for i in range(80) for x in (HEAD, f"Sentence number {i} is here.")]
    text, stats = cleaned(spark, ["\n".join(lines)])[0]
    assert HEAD not in text and stats["removed"]["repeated"] == 80 and stats["repeated_lines"] == 1 and stats["repeat_threshold"] == 4


def test_options(spark):
    text = "Chapter ..... 3\nwww.example.org\n© 2020 A\ncustom 7\nText."
    assert sum(cleaned(spark, [text], remove_toc=False, remove_urls=False, remove_boilerplate=False)[0][1]["removed"].values()) == 0
    assert cleaned(spark, [text], extra_patterns=(r"^CUSTOM \d",))[0][1]["removed"]["custom"] == 1


def test_long_lines(spark):
    """Neither the stack nor quadratic patterns give out."""
    got = cleaned(spark, ["a " * 20_000, "x" * 200_000, "uploaded by " * 3000, "-\n" * 5000, "Word-\n" * 4000 + "x"])
    assert got[0][0] == "" and len(got[1][0]) == 200_000 and got[3][0] == ""


WORDS = st.sampled_from(["word", "Left-", "right", "ends.", "a,", "", " ", "12", "[3]", "•", HEAD, HEAD + "x", "See discussions, stats, and author profiles", "The user has requested enhancement", "SEE PROFILE", "View publication stats", "Über-", "élan", "\t", "page 3", "w i t h a r e", "#%&^^~~", "© 2020", "x\r", "3 authors:"])
TEXTS = st.lists(st.lists(WORDS, min_size=1, max_size=2).map(" ".join), min_size=0, max_size=60).map("\n".join)


@pytest.mark.parametrize("options", [{}, {"aggressive": True}])
def test_model(spark, options):
    """The plan equals the passes in order, on random documents."""
    found = []

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck), database=None, derandomize=True)
    @given(TEXTS)
    def collect(text):
        found.append(text)

    collect()
    for text, (got, stats) in zip(found, cleaned(spark, found, **options), strict=True):
        want, facts = model.clean(text, **options)
        assert got == want, text
        removed = sum(stats["removed"].values())
        assert {k: stats[k] for k in facts if k != "removed"} | {"removed": removed} == facts, text
    assert set(stats["removed"]) == set(COUNTERS.values())


def test_fuzzy():
    assert dice("abcd", "abcd") == 1 and dice("", "") == 1 and dice("abc", "") == 0 and dice("a", "b") == 0 and dice("aaaa", "aaaaaaaaa") == 0
    random.seed(1)
    lines = [f"Running Header Number {i % 10}" for i in range(5)] + ["unlike anything else here"]
    assert fuzzy_repeats(lines, 3) == [True] * 5 + [False]
    # Members of a group that is too small lead none of their own.
    assert fuzzy_repeats(["aaaaaaaaaa", "aaaaaaaaaa"], 3) == [False, False]


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(T.rejoin_spaced(F.lit("t h e r e"))) == "the re"
    assert get(T.fix_umlauts(F.lit("fiir das grobe Feld, üfiir, konnen, langer als, langer"))) == "für das große Feld, üfür, können, länger als, langer"
    assert get(T.count_umlauts(F.lit("fiir iiber fiir"))) == 3
    assert get(T.remove_noise(F.lit("# a       b x % y"))) == "a b x y"
    assert get(T.boundary_slice(F.lit("x START mid END y"), F.lit("START "), F.lit(" END"))) == "mid"
    assert get(T.boundary_slice(F.lit("x START END y"), F.lit("START "), F.lit("END"))) == "x START END y"
    assert get(T.boundary_slice(F.lit("a  b"), F.lit(""), F.lit("b"))) == "a b"
    assert get(T.nfc(F.lit("éa"))) == "éa"
    assert T.valid_patterns(spark, ["/a+/", "(x", "b"]) == ["a+", "b"]
