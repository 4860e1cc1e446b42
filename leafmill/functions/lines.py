"""Line predicates: why a line is removed, if it is."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import is_spaced, let, trim

#: Reasons and the counters that they add to.
COUNTERS = {
    "page_number": "page_numbers", "toc_leader": "toc_leaders", "footnote_marker": "footnote_markers", "orphan_bullet": "orphan_bullets",
    "separator": "orphan_bullets", "boilerplate": "boilerplate", "url": "urls", "ocr_junk": "ocr_junk", "spaced_letters": "spaced_letters",
    "repeated": "repeated", "fuzzy_repeated": "fuzzy_repeated", "custom": "custom",
}


@dataclass(frozen=True)
class CleanOptions:
    """aggressive: also fuzzy repeats, and paragraphs joined whatever ends a line. source: pdf or ocr.
    extra_patterns: Java regular expressions of more lines to remove (case is ignored; see valid_patterns)."""

    aggressive: bool = False
    remove_boilerplate: bool = True
    remove_urls: bool = True
    remove_toc: bool = True
    extra_patterns: tuple[str, ...] = ()
    source: str = "pdf"

    @property
    def ocr(self) -> bool:
        return self.source == "ocr"


@dataclass(frozen=True)
class RowOptions:
    """CleanOptions of each row, as columns: documents of different books go through one plan. extra_patterns is an array."""

    aggressive: Column
    remove_boilerplate: Column
    remove_urls: Column
    remove_toc: Column
    extra_patterns: Column
    source: Column

    @classmethod
    def of(cls, options: Column) -> RowOptions:
        """From a struct column with these fields."""
        return cls(**{f.name: options[f.name] for f in fields(cls)})

    @property
    def ocr(self) -> Column:
        return self.source == "ocr"


#: All patterns at a line's start that name words; the others ask for fewer words, or have words of their own (ANYWHERE).
PLAIN = P.plain([p for p in P.BOILERPLATE + P.COPYRIGHT + P.ACADEMIC + P.PROFILE_PAGES if p not in P.ANYWHERE])


def either(flag: bool | Column, yes: Column, no: Column) -> Column:
    """``yes`` or ``no`` by an option: a constant leaves one of them in the plan, a column decides row by row."""
    if isinstance(flag, Column):
        return F.when(flag, yes).otherwise(no)
    return yes if flag else no


def _is(line: Column, patterns: list[str]) -> Column:
    return F.regexp_like(line, F.lit(P.any_of(patterns)))


def is_blank(line: Column) -> Column:
    return trim(line) == ""


def is_page_number(line: Column, before: Column, after: Column) -> Column:
    """Decorated numbers anywhere, bare ones between blank lines."""
    return _is(line, P.PAGE_NUMBER) | (is_blank(before) & is_blank(after) & _is(line, P.BARE_PAGE))


def is_toc_leader(line: Column) -> Column:
    """Only lines that end in a digit are looked at."""
    return F.substring(F.rtrim(line, F.lit(" \t\r\n\x0b\f")), -1, 1).between("0", "9") & _is(line, P.TOC_LEADER)


def is_footnote_marker(line: Column) -> Column:
    return _is(line, P.FOOTNOTE)


def is_orphan_bullet(line: Column) -> Column:
    return _is(line, P.BULLET)


def is_separator(line: Column) -> Column:
    return _is(line, P.SEPARATOR)


def is_boilerplate(line: Column) -> Column:
    """Patterns that begin at the start run as one; the others only on lines that have the words they need."""
    every = P.BOILERPLATE + P.COPYRIGHT + P.ACADEMIC + P.PROFILE_PAGES
    found = _is(line, [p for p in every if p not in P.ANYWHERE])

    def anywhere(low: Column) -> Column:
        out = F.lit(False)
        for p, words in P.ANYWHERE.items():
            out = out | (F.contains(low, F.lit(words)) & _is(line, [p]))
        return out

    return found | let(F.lower(line), anywhere)


def marks_of(low: Column) -> Column:
    """Of the words that patterns anywhere in a line need, those that a text in lower case has."""
    return F.filter(F.array(*map(F.lit, dict.fromkeys(P.ANYWHERE.values()))), lambda w: F.contains(low, w))


def is_plain(trimmed: Column, low: Column, marks: Column) -> Column:
    """Whether no test of a line alone can hold, custom patterns aside: prose, as most lines are, is read by one pattern and is done. marks: marks_of the text."""
    return F.regexp_like(trimmed, F.lit(PLAIN)) & ~F.exists(marks, lambda w: F.contains(low, w))


def is_url(line: Column) -> Column:
    return _is(line, P.URL_LINE)


def is_ocr_junk(line: Column, ocr: bool | Column) -> Column:
    """Few words, no digit, and too few letters and spaces for the length. A line is read up to the word that is enough."""
    t = trim(line)
    wordy = lambda n: F.regexp_like(t, F.lit(P.words(n)))
    enough, share = either(ocr, wordy(3), wordy(2)), either(ocr, F.lit(0.25), F.lit(0.35))
    letters = F.length(t) - F.length(F.regexp_replace(t, r"[ A-Za-z\x{C0}-\x{24F}]", ""))
    return (F.length(t) > 4) & ~enough & ~F.regexp_like(t, F.lit(r"\d")) & (letters / F.length(t) < share)


def long_enough(trimmed: Column) -> Column:
    return F.length(trimmed) >= 25


def may_repeat(trimmed: Column) -> Column:
    """Whether a line is long and wordy enough to count as a repeated header."""
    return long_enough(trimmed) & ~F.regexp_like(trimmed, F.lit(P.DIGITS_ONLY)) & ~F.regexp_like(trimmed, F.lit(P.NUMERIC_ONLY)) & F.contains(trimmed, F.lit(" "))


def repeat_threshold(lines: Column, aggressive: bool | Column) -> Column:
    """Times that a line must be there to count as repeated, from the number of lines."""
    low = F.greatest(F.lit(2), F.floor(1 + F.sqrt(lines / 30)).cast("int"))
    return either(aggressive, low, F.greatest(F.lit(3), F.floor(2 + F.sqrt(lines / 25)).cast("int")))


def drop_reason(line: Column, before: Column, after: Column, plain: Column, repeated: Column, fuzzy: Column, o: CleanOptions | RowOptions) -> Column:
    """The first reason that holds, or null. Reasons that are switched off for all rows aren't in the plan. plain: is_plain of the line, of which the first
    reasons needn't be asked."""
    by_row = isinstance(o, RowOptions)
    if by_row:
        custom, some = F.exists(o.extra_patterns, lambda p: F.regexp_like(line, F.concat(F.lit("(?i)"), p))), True
    else:
        some = bool(o.extra_patterns)
        custom = _is(line, [f"(?i){p}" for p in o.extra_patterns]) if some else None
    steps = [
        ("page_number", is_page_number(line, before, after), True), ("toc_leader", is_toc_leader(line), o.remove_toc), ("footnote_marker", is_footnote_marker(line), True),
        ("orphan_bullet", is_orphan_bullet(line), True), ("separator", is_separator(line), True), ("boilerplate", is_boilerplate(line), o.remove_boilerplate),
        ("url", is_url(line), o.remove_urls), ("ocr_junk", is_ocr_junk(line, o.ocr), True), ("spaced_letters", is_spaced(line), True),
    ]
    others = [("repeated", repeated, True), ("fuzzy_repeated", fuzzy, o.aggressive), ("custom", custom, some)]

    def first(tests: list) -> Column:
        out = None
        for name, holds, on in tests:
            if isinstance(on, Column):
                holds = on & holds
            elif not on:
                continue
            out = F.when(holds, name) if out is None else out.when(holds, name)
        return out

    return F.coalesce(F.when(~plain, first(steps)), first(others))
