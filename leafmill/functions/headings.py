"""Heading templates: placeholders compiled to regular expressions, ordinals, centring."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values ---------------------------------------------------------------------------

PAGE_WIDTH, CENTRE_TOLERANCE, CENTRED_WIDTH = 2480, 100, 0.99
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
PARAGRAPH_ENDS = ["!", "?", ".»", "!»", "?»"]


def _roman(n: int) -> str:
    tens = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC", "C"]
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    return tens[n // 10] + ones[n % 10]


#: I to C, by rule.
ROMAN = {_roman(n): n for n in range(1, 101)}
#: German ordinals of 1 to 50, in order.
ORDINAL_WORDS = """
erster zweiter dritter vierter fünfter sechster siebter achter neunter zehnter elfter zwölfter dreizehnter vierzehnter fünfzehnter sechzehnter siebzehnter achtzehnter neunzehnter zwanzigster
einundzwanzigster zweiundzwanzigster dreiundzwanzigster vierundzwanzigster fünfundzwanzigster sechsundzwanzigster siebenundzwanzigster achtundzwanzigster neunundzwanzigster dreißigster
einunddreißigster zweiunddreißigster dreiunddreißigster vierunddreißigster fünfunddreißigster sechsunddreißigster siebenunddreißigster achtunddreißigster neununddreißigster vierzigster
einundvierzigster zweiundvierzigster dreiundvierzigster vierundvierzigster fünfundvierzigster sechsundvierzigster siebenundvierzigster achtundvierzigster neunundvierzigster fünfzigster
"""
#: The seventh has two forms.
ORDINALS = {w: n for n, w in enumerate(ORDINAL_WORDS.split(), 1)} | {"siebenter": 7}


def _placeholders() -> dict[str, str]:
    months, ends = "|".join(MONTHS), "|".join(map(re.escape, PARAGRAPH_ENDS))
    return {
        "roman-number": rf"\b({'|'.join(ROMAN)})\b",
        "title-in-capital-letters": "([A-ZÄÖÜ0-9][A-ZÄÖÜ «»-]*)",
        "decimal-number": r"(\d+)",
        "title": "([A-ZÄÖÜ«»-][^.]{2,}?)",
        "title-with-decimal-number": rf"(\d+\.\s+(?!(?:{months})\b)[A-ZÄÖÜ«»-][^.]{{2,}}?)",
        "german-ordinal": f"({'|'.join(ORDINALS)})",
        "place": r"([A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)*)",
        "long-date": rf"(\d{{1,2}}\.\s+(?:{months})\s+\d{{4}})",
        "no-paragraph-end-marker": rf"((?:(?!({ends})\Z)(?![0-9a-z])[\s\S])+?)",
    }


PLACEHOLDERS = _placeholders()


@lru_cache(maxsize=1024)
def compile_template(template: str) -> str:
    """An anchored regular expression (for Python); the first of each placeholder is filled, and what else has a
    meaning in one, but for braces, brackets and bars, stands for itself. An unknown placeholder stays as it is."""
    out = re.sub(r"[.*+?^$\\]", lambda m: "\\" + m[0], template)
    for name, pattern in PLACEHOLDERS.items():
        out = out.replace(f"{{{name}}}", pattern, 1)
    return rf"^{out}\Z"


def placeholder_names(template: str) -> list[str]:
    return re.findall(r"{([^}]+)}", template)


def match_heading(text: str, template: str) -> dict[str, str] | None:
    """Captured values by placeholder, in order of groups (an inner group of one shifts the next), or None."""
    try:
        m = re.search(compile_template(template), text.strip())
    except re.error:
        return None
    if not m:
        return None
    return {"": m[0]} | {k: v for k, v in zip(placeholder_names(template), m.groups(), strict=False) if v is not None}


#: The group within a placeholder's look-ahead: it shifts the names of later groups and never holds anything.
_NEVER_SET = "no-paragraph-end-marker"
_SPACES = " \\t\\n\\x0b\\f\\r\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def java_template(template: str) -> tuple[str, list[tuple[int, str]]] | None:
    """A template as a Java expression with the groups that give values: (group, placeholder). None if it is no expression."""
    try:
        groups = re.compile(compile_template(template)).groups
    except re.error:
        return None
    names, shown, empty = placeholder_names(template), [], set()
    at = 1
    for name in names:
        if name in PLACEHOLDERS:
            if name == _NEVER_SET:
                empty.add(at + 1)
            at += re.compile(PLACEHOLDERS[name]).groups
    shown = [(g, n) for g, n in zip(range(1, groups + 1), names, strict=False) if g not in empty]
    # A brace that begins no count stands for itself.
    pattern = re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})", r"\\{", compile_template(template)).replace(r"\Z", r"\z").replace(r"\s", f"[{_SPACES}]")
    return pattern, shown


def heading_captures(text: Column, template: str) -> Column:
    """match_heading as a map column: captured values by placeholder, or null where the template doesn't match."""
    compiled = java_template(template)
    none = F.lit(None).cast("map<string,string>")
    if compiled is None:
        return none
    pattern, shown = compiled
    trimmed = F.regexp_replace(text, f"^[{_SPACES}]+|[{_SPACES}]+\\z", "")
    pairs = [F.struct(F.lit(n).alias("k"), F.regexp_extract(trimmed, pattern, g).alias("v")) for g, n in dict((n, (g, n)) for g, n in shown).values()]
    found = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    return F.when(F.regexp_like(trimmed, F.lit(pattern)), found)


def heading_level(text: Column, levels: list[list[str]]) -> Column:
    """level (from 1), template and values of the first template that matches, level by level; null if none does."""
    out = None
    for level, templates in enumerate(levels, 1):
        for template in templates:
            values = heading_captures(text, template)
            hit = F.struct(F.lit(level).alias("level"), F.lit(template).alias("template"), values.alias("values"))
            out = F.when(values.isNotNull(), hit) if out is None else out.when(values.isNotNull(), hit)
    return out if out is not None else F.lit(None).cast("struct<level:int,template:string,values:map<string,string>>")


def ordinal_value(roman: Column, decimal: Column, ordinal: Column) -> Column:
    """Value of the first of a Roman number, a decimal one and a German ordinal that is known."""
    lookup = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    digits = F.regexp_extract(decimal, r"^\s*(\d+)", 1)
    return F.coalesce(F.try_element_at(lookup(ROMAN), F.coalesce(roman, F.lit(""))), F.when(digits != "", digits.cast("int")), F.try_element_at(lookup(ORDINALS), F.lower(F.coalesce(ordinal, F.lit("")))))


def is_centred(x0: Column, x1: Column, paragraph_width: Column) -> Column:
    """In the middle of the page and narrower than its paragraphs; without their width any line is narrow."""
    near = F.abs((x0 + x1) / 2 - PAGE_WIDTH / 2) <= CENTRE_TOLERANCE
    return near & (F.coalesce(paragraph_width, F.lit(0.0)).eqNullSafe(0.0) | (x1 - x0 <= paragraph_width * CENTRED_WIDTH))
