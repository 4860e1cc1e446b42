"""Column functions over whole texts: character normalisation, white space, markers, noise, misread words."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P


#: A character that normalisation of a line may change or drop, and others beside it: few ranges, since each character of a text is asked for each.
UNUSUAL = r"[\x{0}-\x{8}\x{B}-\x{C}\x{E}-\x{1F}\x{7F}-\x{A0}\x{1680}-\x{FFFF}]"

#: No line without one of these has an unusual character; most lines have none, which two ranges tell.
BEYOND_LATIN = r"[^ -~\x{A1}-\x{24F}]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often and deep body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def trim(c: Column) -> Column:
    """Without tabs, line ends and spaces at both ends."""
    return F.btrim(c, F.lit(" \t\r\n"))


def normalize_unicode(text: Column) -> Column:
    """Form feeds as line ends, control characters dropped, ligatures, quotes, dashes and spaces in ASCII.

    All characters that become one other, or none, go in a single translate."""
    singles = P.QUOTES | {c: " " for c in P.SPACES}
    out = F.replace(text, F.lit("\f"), F.lit("\n"))
    out = F.translate(out, "".join(singles) + P.CONTROL + P.DELETED, "".join(singles.values()))
    for old, new in {**P.LIGATURES, **P.WIDE}.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def collapse_whitespace(text: Column) -> Column:
    """Each run of two white-space characters or more, line ends included, as one space."""
    # Letters and signs of ASCII, that most characters are, are passed over by one range.
    return F.regexp_replace(text, f"(?![!-~]){P.JS_SPACE}{{2,}}", " ")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """Canonical composition. No character below U+0300 is changed by it, so most texts never leave the JVM:
    only those with one beyond go through Arrow."""
    return F.coalesce(_nfc(F.when(F.regexp_like(text, F.lit(r"[^\x{0}-\x{2FF}]")), text)), text)


def normalize_text(text: Column) -> Column:
    """Composed, white space as single spaces, stray diaereses composed, trimmed: for comparing markers."""
    out = F.regexp_replace(nfc(text), P.JS_SPACE + "+", " ")
    for a in "aouAOU":
        out = F.replace(out, F.lit(a + "̈"), F.lit({"a": "ä", "o": "ö", "u": "ü", "A": "Ä", "O": "Ö", "U": "Ü"}[a]))
    return F.btrim(F.replace(out, F.lit("ṣ"), F.lit("ß")))


def contains_marker(text: Column, marker: Column) -> Column:
    """Whether a normalised text has a normalised marker; an empty marker is in none."""
    m = normalize_text(marker)
    return F.coalesce((m != "") & F.contains(normalize_text(text), m), F.lit(False))


def boundary_slice(text: Column, before: Column, after: Column) -> Column:
    """Text after the first ``before`` up to the first ``after`` from there; a marker that is missing doesn't cut.
    Without both markers given, only white space is collapsed. If the end comes first, all is kept."""
    # Each is computed once. Runs of white space and composition don't touch each other, so composition sees the text as it came.
    parts = F.struct(nfc(text).alias("c"), nfc(before).alias("b"), nfc(after).alias("a"))

    def sliced(x: Column) -> Column:
        found = let(collapse_whitespace(x["c"]), lambda t: let(F.instr(t, x["b"]), lambda at: F.struct(t.alias("t"), F.when(at > 0, at + F.length(x["b"])).otherwise(1).alias("s"), (at > 0).alias("found"), x["a"].alias("a"))))
        none = (F.coalesce(x["b"], F.lit("")) == "") | (F.coalesce(x["a"], F.lit("")) == "")
        return F.when(none, collapse_whitespace(text)).otherwise(let(found, _cut))

    return let(parts, sliced)


def _cut(x: Column) -> Column:
    # An end at the start leaves nothing between the markers: then the whole document is kept.
    cut = lambda end: F.when(x["found"] & (end > 0) & (end <= x["s"]), x["t"]).when(end > 0, F.substring(x["t"], x["s"], end - x["s"])).otherwise(F.substring(x["t"], x["s"], F.length(x["t"])))
    return let(F.position(x["a"], x["t"], x["s"]), cut)


def remove_noise(text: Column) -> Column:
    """Runs of spaces and stray single signs of character recognition."""
    clear = lambda t, steps: reduce(lambda x, step: F.regexp_replace(x, *step), steps, t)
    runs = [step for step in P.NOISE if r"\s{6,}" in step[0]]
    # Steps that need a run of six are the first; texts without one are spared them.
    wide = let(text, lambda t: F.when(F.regexp_like(t, F.lit(r"\s{6}")), clear(t, runs)).otherwise(t))
    return trim(clear(wide, P.NOISE[len(runs) :]))


def _umlaut_steps() -> Column:
    """In order: a pattern, what replaces it, and what a text must have in lower case to be searched for it."""
    steps = [(f"(?i){P.java_words(p)}", r, P.needed(p)) for p, r in P.UMLAUTS] + [(P.java_words(p), r, P.needed(p)) for p, r in P.UMLAUTS_INSIDE]
    return F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(("pattern", "new", "needed"), s, strict=True))) for s in steps))


def _with_lower(text: Column) -> Column:
    return F.struct(text.alias("t"), F.lower(text).alias("low"))


def fix_umlauts(text: Column) -> Column:
    step = lambda x, s: F.when(F.contains(x["low"], s["needed"]), let(F.regexp_replace(x["t"], s["pattern"], s["new"]), _with_lower)).otherwise(x)
    return F.aggregate(_umlaut_steps(), let(text, _with_lower), step)["t"]


def count_umlauts(text: Column) -> Column:
    """Corrections, counted on the text as it came."""
    count = lambda x, s: F.when(F.contains(x["low"], s["needed"]), F.regexp_count(x["t"], s["pattern"])).otherwise(0)
    return let(let(text, _with_lower), lambda x: F.when(x["t"].isNotNull(), F.aggregate(_umlaut_steps(), F.lit(0), lambda n, s: n + count(x, s)))).cast("long")


def valid_patterns(spark, patterns: list[str]) -> list[str]:
    """The patterns that compile; others are skipped. ``/.../`` stands for what is between."""
    out = []
    for p in patterns:
        body = p[1 : p.rindex("/")] if len(p) > 1 and p.startswith("/") and p.rindex("/") > 0 else p
        try:
            spark._jvm.java.util.regex.Pattern.compile(body)
        except Exception:  # noqa: BLE001  java's PatternSyntaxException
            continue
        out.append(body)
    return out


def remove_patterns(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def rejoin_spaced(line: Column) -> Column:
    """A line of single spaced letters as syllables of two letters or more, else as it is."""
    raw = F.regexp_replace(trim(line), r"\s+", "")
    words = F.array_join(F.filter(F.regexp_extract_all(raw, F.lit(f"({P.SYLLABLE})"), F.lit(1)), lambda w: F.length(w) >= 2), " ")
    return F.when(is_spaced(line), F.when(F.length(words) > 0, words).otherwise(raw)).otherwise(line)


def is_spaced(line: Column) -> Column:
    """Possessive, so that the longest line can't exhaust the stack; it gives up nothing on a trimmed line."""
    pattern = P.SPACED_LETTERS.replace(r"\s+){3,}", r"\s++){3,}+")
    return (F.length(trim(line)) >= 7) & F.regexp_like(trim(line), F.lit(pattern))
