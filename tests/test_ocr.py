import pytest

from leafmill.functions.headings import ORDINALS, ROMAN, compile_template, match_heading
from leafmill.operators.ocr import MissingMetrics, append_line, assemble_books, clusters, heading_at, join_pages, page_metrics, page_text, raised_mark, structure_pages
from leafmill.plans import queries as Q


def line(text, x0=300.0, x1=2100.0, symbols=()):
    return {"text": text, "x0": x0, "y0": 0.0, "x1": x1, "y1": 40.0, "symbols": list(symbols)}


def test_clusters():
    got = clusters([300, 340, 304, 345], [10, 20, 30, 40])
    assert [g["values"] for g in got] == [[300, 304], [340, 345]]
    assert [g["widths"] for g in got] == [[10, 20], [30, 40]]  # widths aren't sorted along


def test_metrics():
    lines = [line("x", x) for x in (300, 301, 302, 341, 500)]
    got = {m["type"]: m["min_x0"] for m in page_metrics(lines, {"paragraph-start": 40})}
    assert got == {"paragraph-text": 300, "paragraph-start": 341, "unknown-1": 500}
    assert page_metrics([], None) == []
    with pytest.raises(MissingMetrics):
        page_metrics(lines, None, "novel")


def test_raised_mark():
    s = lambda t, y1=10.0, base=40.0: {"text": t, "y0": 0.0, "y1": y1, "base_y1": base}
    assert raised_mark(line("12 x", symbols=[s("1"), s("2"), s("x")])) == "12"
    assert raised_mark(line("1", symbols=[s("1", 39.0)])) == "" and raised_mark(line("1", symbols=[s("1", base=None)])) == "" and raised_mark(line("1")) == ""


def test_headings():
    assert len(ROMAN) == 100 and ROMAN["XCIX"] == 99 and ORDINALS["siebenter"] == 7 and ORDINALS["siebzehnter"] == 17 and len(ORDINALS) == 51
    assert match_heading("XIV", "{roman-number}") == {"": "XIV", "roman-number": "XIV"}
    assert match_heading("ERSTER VORTRAG", "{german-ordinal} VORTRAG") is None  # ordinals are lower case, letters count
    assert match_heading("erster VORTRAG", "{german-ordinal} VORTRAG")["german-ordinal"] == "erster"
    assert match_heading("12. Mai 1910", "{title-with-decimal-number}") is None and match_heading("12. Maler", "{title-with-decimal-number}")
    open_end = "{no-paragraph-end-marker}"
    assert match_heading("EIN SATZ.", open_end) and match_heading("EIN SATZ!", open_end) is None and match_heading("EIN SATZ.»", open_end) is None and match_heading("Ein", open_end) is None
    assert match_heading("x", "(x") is None and compile_template("a.b") == r"^a\.b\Z"


def test_heading_lines():
    levels = [[{"pattern": "{title-in-capital-letters}", "multiple_lines": True}]]
    lines = [line("EIN TITEL", 1000, 1480), line("MIT ZEILEN", 1000, 1480), line("Text.")]
    assert heading_at(0, lines, levels, []) == ("\n\n# EIN TITEL MIT ZEILEN\n\n", 2)
    assert heading_at(0, [line("EIN TITEL"), line("geht weiter")], levels, []) is None
    assert heading_at(0, [line("Text.")], levels, []) is None


def test_page_text():
    mark = {"text": "1", "y0": 0.0, "y1": 10.0, "base_y1": 40.0}
    lines = [line("first line-"), line("less text"), line("New one.", 340), line("1 note", 320, symbols=[mark]), line("it goes on", 360)]
    metrics = [{"type": t, "min_x0": a, "max_x0": a, "max_width": 1800} for t, a in (("paragraph-text", 300), ("paragraph-start", 340), ("footnote-text", 360))]
    assert page_text(lines, [], metrics) == ("first lineless text\n\nNew one.", "\n\n[^1]: note it goes on")
    assert page_text([], [], []) == ("", "")


def test_joins():
    assert append_line("a-", "b") == "ab" and append_line("a-", "B") == "a- B" and append_line("", "b") == "b"
    assert join_pages("a- ", "b") == "ab" and join_pages("a-", "B") == "a- B" and join_pages("a-", "1") == "a1" and join_pages("", "b") == "b"


LINES = [
    (1, 1, 0, "I", 1200.0, 1280.0, ""), (1, 1, 1, "This is a first line of text that goes", 340.0, 2150.0, ""), (1, 1, 2, "on to the next line, which ends here.", 300.0, 2160.0, ""),
    (1, 1, 3, "Another line of the same paragraph-", 301.0, 2150.0, ""), (1, 1, 4, "less page, and so it goes.", 299.0, 1900.0, ""), (1, 1, 5, "1 A note about it.", 320.0, 1500.0, "1"),
    (1, 2, 0, "II", 1210.0, 1270.0, ""), (1, 2, 1, "more lines follow", 302.0, 2100.0, ""), (1, 2, 2, "** Two stars.", 320.0, 1300.0, "**"), (2, 1, 0, "EIN TITEL", 900.0, 1580.0, ""), (2, 1, 1, "MIT ZWEI ZEILEN", 905.0, 1575.0, ""),
    (2, 1, 2, "Der Text beginnt.", 300.0, 2000.0, ""), (2, 1, 3, "Und er endet.", 300.0, 1000.0, ""),
]


def test_books(spark):
    symbol = lambda c: (c, 0.0, 10.0, 40.0)
    pages = {}
    for book, page, _, text, x0, x1, mark in LINES:
        pages.setdefault((book, page), []).append((text, x0, 0.0, x1, 40.0, [symbol(c) for c in mark]))
    rows = spark.createDataFrame([(*k, v) for k, v in pages.items()], "book_id long, page_no int, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double,symbols:array<struct<text:string,y0:double,y1:double,base_y1:double>>>>")
    books = {r.book_id: r.text for r in assemble_books(structure_pages(rows, Q.LEVELS, Q.OFFSETS)).collect()}
    assert books[1].startswith("\n\n# I\n\n") and "paragraphless" in books[1] and books[1].count("[^") == 2 and "# FUSSNOTEN" in books[2]
    assert "# EIN TITEL MIT ZWEI ZEILEN" in books[2]
