"""Patterns of the cleaner, in a form that java.util.regex and RE2 read alike.

Written for lines after character normalisation, whose only white space is tab, carriage return and
space. ``\\z`` ends a line (``$`` would also stop before a final line end), ``[^\\n\\r]`` stands for any
character, and word edges are written out, since Java's ``\\b`` knows all Unicode letters.
"""

from __future__ import annotations

import re

_ANY = r"[^\n\r]"
_EDGE = r"(?:[^A-Za-z0-9_]|\z)"
_START = r"(?:^|[^A-Za-z0-9_])"
_LATIN = r"[A-Za-z0-9_\x{C0}-\x{24F}]"

# -- fixed values ---------------------------------------------------------------------------

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
QUOTES = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-"}
WIDE = {"—": "--", "―": "--", "…": "..."}
DELETED = "​‌‍﻿"
SPACES = "                 　"
#: Control characters that are dropped: all but tab, line feed, form feed (a line end) and carriage return.
CONTROL = "".join(map(chr, [*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F]))
#: White space as JavaScript's \s has it.
JS_SPACE = r"[\t\n\x0b\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SENTENCE_ENDS = ".!?:;\"')]}”’"

PAGE_NUMBER = [
    r"^\s*[-\x{2013}\x{2014}]\s+\d{1,4}\s+[-\x{2013}\x{2014}]\s*\z",
    r"(?i)^\s*page\s+\d{1,4}\s+of\s+\d{1,4}\s*\z",
    r"^\s*\|\s*\d{1,4}\s*\|\s*\z",
    r"(?i)^\s*\|\s*[ivxlcdm]+\s*\|\s*\z",
]
BARE_PAGE = [r"^\s*\d{1,4}\s*\z", r"(?i)^\s*page\s+\d{1,4}\s*\z", r"(?i)^\s*p\.?\s*\d{1,4}\s*\z"]
TOC_LEADER = [
    rf"^{_ANY}{{2,60}}\s*[.\x{{B7}}\x{{2026}}]{{3,}}\s*\d{{1,4}}\s*\z",
    rf"^{_ANY}{{2,60}}\s*_{{3,}}\s*\d{{1,4}}\s*\z",
    rf"^{_ANY}{{2,60}}\s*-{{3,}}\s*\d{{1,4}}\s*\z",
]
FOOTNOTE = [r"^\s*\[\d{1,3}\]\s*\z", r"^\s*\d{1,3}\.\s*\z", r"^\s*[*\x{2020}\x{2021}\x{A7}\x{B6}]\s*\z"]
BULLET = [
    r"^\s*[\x{2022}\x{25AA}\x{25B8}\x{25B9}\x{25BB}\x{25BA}\x{25B6}\x{2023}\x{27A4}\x{279C}\x{25C6}\x{25C7}\x{25CB}\x{25CF}\x{25C9}\x{25A0}\x{25A1}\x{25B7}]\s*\z",
    r"^\s*[-\x{2013}\x{2014}]\s*\z",
]
SEPARATOR = [r"^\s*[|\x{2502}\x{2503}]\s*\z"]
URL_LINE = [r"(?i)^\s*(https?://\S+|www\.\S+|\S+@\S+\.\S+)\s*\z"]
BOILERPLATE = [
    r"(?i)^\s*confidential\s*\z",
    r"(?i)^\s*draft\s*\z",
    r"(?i)^\s*do not distribute\s*\z",
    r"(?i)^\s*do not copy\s*\z",
    r"(?i)^\s*not for distribution\s*\z",
    r"(?i)^\s*internal use only\s*\z",
    r"(?i)^\s*for internal use\s*\z",
    r"(?i)^\s*proprietary\s*(and|&)\s*confidential\s*\z",
    r"(?i)^\s*all rights reserved\.?\s*\z",
    rf"^\s*\x{{A9}}{_ANY}*\d{{4}}{_ANY}*\z",
    rf"(?i)^\s*copyright\s+{_ANY}*\d{{4}}{_ANY}*\z",
    rf"(?i)^\s*printed in\s+{_ANY}+\z",
    r"(?i)^\s*ISBN[\s:=-]*[\d-]+\s*\z",
    r"(?i)^\s*alle rechte vorbehalten\.?\s*\z",
]
COPYRIGHT = [rf"(?:^|\s)\x{{A9}}\s*\d{{4}}{_EDGE}"]
ACADEMIC = [
    r"(?i)^\s*Available\s+online\s+\d",
    rf"(?i)^\s*Received\s+{_ANY}*Accept",
    r"(?i)^\s*Contents\s+lists?\s+available\s+at\s+",
    r"(?i)^\s*journal\s+homepage\s*:",
    r"(?i)^\s*ScienceDirect\s*\z",
    r"(?i)^\s*JSTOR\s*\z",
    r"(?i)^\s*Springer\s*\z",
    r"(?i)^\d{4}\s+Elsevier",
    r"(?i)^\s*Elsevier\s+(Ltd|B\.V\.|Inc|BV)\s*\z",
    r"(?i)^\s*doi\s*:",
    r"(?i)^\s*https?://doi\.org/\S+\s*\z",
    r"(?i)^\s*https?://dx\.doi\.org/\S+\s*\z",
]
SIGNATURE = r"(?i)See discussions, stats, and author profiles"
SECTION_END = [r"(?i)The user has requested enhancement", r"(?i)All content following this page was uploaded"]
SECTION_MORE = [
    rf"(?i)^\s*\d+\s+(PUBLICATIONS|READS|CITATIONS){_EDGE}",
    r"(?i)^\s*(PUBLICATIONS|READS|CITATIONS)\s*\z",
    r"(?i)^\s*SEE PROFILE\s*\z",
    r"(?i)^\s*View\s+project\s*\z",
    r"(?i)^\s*\d+\s+authors?\s*:",
    r"(?i)^\s*https?://www\.researchgate\.net/\S+\s*\z",
    rf"(?i)^\s*{_LATIN}+(?:\s+{_LATIN}+){{0,4}}\s+University\s*\z",
    rf"(?i){_START}View\s+publication\s+stats?{_EDGE}",
]
TRAILING = r"(?i)^\s*View\s+publication\s+stats?\s*\z"
#: Of the patterns of profile pages, those that other lists name too.
VIEW_PROJECT = r"(?i)^\s*[A-Za-z0-9_][A-Za-z0-9_\s]*View\s+project\s*[A-Za-z0-9_\s]*\z"
UPLOADED_BY = rf"(?i)uploaded by\s+{_ANY}*\s+on\s+{_ANY}*20[0-9]\d"
RELATED_PROJECTS = r"(?i)Some of the authors of this publication are also working on these related projects"
SLIDESHARE = r"(?i)www\.slideshare\.net"
ACADEMIA = r"(?i)Academia\.edu"
PROFILE_PAGES = [
    SIGNATURE,
    SECTION_MORE[0],
    SECTION_MORE[1],
    SECTION_MORE[2],
    VIEW_PROJECT,
    SECTION_MORE[7],
    SECTION_END[1],
    SECTION_END[0],
    UPLOADED_BY,
    SECTION_MORE[4],
    SECTION_MORE[6],
    RELATED_PROJECTS,
    r"(?i)^\s*SlideShare\s*\z",
    SLIDESHARE,
    ACADEMIA,
    r"(?i)^\s*[A-Za-z]+\s*\x{B7}\s*\d{4}\s*\z",
    r"(?i)^\s*[A-Za-z]+\s+\x{B7}\s+[A-Za-z]+\s+\d{4}\s*\z",
    r"(?i)^\s*\d+\s+PUBLICATIONS\s+\d",
    SECTION_MORE[5],
]
#: What the patterns of PROFILE_PAGES and COPYRIGHT that may begin anywhere, or look at many words, must have, in lower case. Each text begins with a letter or sign that
#: prose has seldom, so that a search stops at few places, and is shared by as many patterns as it can be.
ANYWHERE = {
    SIGNATURE: ", stats, and",
    SECTION_MORE[7]: "publication",
    SECTION_END[0]: "quested enhancement",
    SECTION_END[1]: "ploaded",
    UPLOADED_BY: "ploaded",
    RELATED_PROJECTS: "publication",
    SLIDESHARE: ".slideshare.net",
    ACADEMIA: ".edu",
    COPYRIGHT[0]: "\u00a9",
    VIEW_PROJECT: "view",
    SECTION_MORE[6]: "versity",
}
SPACED_LETTERS = r"^(?:[a-zA-Z]\s+){3,}[a-zA-Z]?\s*\z"
DIGITS_ONLY = r"^\d+\z"
NUMERIC_ONLY = r"^[\d.,/\-+\x{D7}*=|: ]+\z"
SYLLABLE = r"(?i)[aeiouy]*[bcdfghjklmnpqrstvwxyz]+[aeiouy]*|[^\n\r]"

#: Misread German words and what they were, in order; matches ignore ASCII case.
UMLAUTS = [
    (r"\bEr[o0]ffn", "Eröffn"), (r"\bk[o0]nnen\b", "können"), (r"\bm[o0]glich", "möglich"), (r"\bf[o0]rder", "förder"), (r"\bg[o0]ttlich", "göttlich"),
    (r"\bHinzufligungen\b", "Hinzufügungen"), (r"\bVerfligungen\b", "Verfügungen"), (r"\biiber\b", "über"), (r"\bfiir\b", "für"), (r"\bnatiirlich", "natürlich"),
    (r"\bspriiren\b", "spüren"), (r"\bmiissen\b", "müssen"), (r"\bwiirde\b", "würde"), (r"\bkiinstler", "künstler"), (r"\bzuriick", "zurück"),
    (r"\bRiickzug", "Rückzug"), (r"\bverfafit\b", "verfaßt"), (r"\bverfaflen\b", "verfaßten"), (r"\bverfafler\b", "verfaßter"),
    (r"\berklaren\b", "erklären"), (r"\bandern\b", "ändern"), (r"\bregelmaBig\b", "regelmäßig"), (r"\blanger\b(?=\s+(als|werden|machen))", "länger"),
    (r"\bgroBe\b", "große"), (r"\bweiB\b", "weiß"), (r"\bmuBte\b", "mußte"), (r"\bdaB\b", "daß"), (r"\bschlieBlich\b", "schließlich"),
    (r"\bgroBer\b", "größer"), (r"\bgroBte\b", "größte"), (r"\bheiBt\b", "heißt"), (r"\bZdee\b", "Idee"), (r"\bSiche\b", "Siehe"),
]
#: The last three keep what stands around the misread letters and mind the case.
UMLAUTS_INSIDE = [(r"\b([a-zA-Z]+)iii([a-zA-Z]+)\b", "$1üi$2"), (r"\b([a-zA-Z]+)iie([a-zA-Z]+)\b", "$1üe$2"), (r"\b([a-zA-Z]+)iien\b", "$1üen")]
#: Steps that clear noise of character recognition, in order.
NOISE = [
    (r"([^a-zA-ZäöüÄÖÜß])\s{6,}([^a-zA-ZäöüÄÖÜß])", "$1 $2"),
    (r"([^a-zA-ZäöüÄÖÜß])\s{6,}", "$1 "),
    (r"\s{6,}([^a-zA-ZäöüÄÖÜß])", " $1"),
    (r"\s{6,}", " "),
    (r"\s([^a-zA-ZäöüÄÖÜß])\s", " "),
    (r"^([^a-zA-ZäöüÄÖÜß])\s", ""),
    (r"\s([^a-zA-ZäöüÄÖÜß])\z", ""),
    (r"\s{2,}", " "),
]

# -- renderings -----------------------------------------------------------------------------


def any_of(patterns: list[str]) -> str:
    """One alternation; a pattern that ignores case keeps that to itself. Those that begin at the line's start are tried there
    and nowhere else, which matters on long lines."""
    anchored, free = [], []
    for p in patterns:
        flag, body = ("(?i:", p[4:]) if p.startswith("(?i)") else ("(?:", p)
        alone = body.startswith("^")
        (anchored if alone else free).append(f"{flag}{body[alone:]})")
    return "|".join([f"^(?:{'|'.join(anchored)})"] * bool(anchored) + free)


def words(n: int) -> str:
    """A line with ``n`` runs of three letters or more: read once, from its start."""
    return r"^(?:[^A-Za-z]|[A-Za-z]{1,2}+(?![A-Za-z]))*+" + r"[A-Za-z]{3,}+(?:[^A-Za-z]|[A-Za-z]{1,2}+(?![A-Za-z]))*+" * (n - 1) + "[A-Za-z]{3}"


def plain(patterns: list[str]) -> str:
    """Trimmed lines that none of ``patterns`` at a line's start, and no test of short lines, can be about: a letter first and not the letters that one
    of the patterns begins with, white space within, three words, and no digit last. Patterns that don't begin with letters ask for another
    sign first, for a digit last, or for fewer words."""
    starts = sorted({m[1].lower() for p in patterns if (m := re.match(r"(?:\(\?i\))?\^(?:\\s\*)?([A-Za-z]{1,3})(?![?*{])", p))})
    return rf"^(?!(?i:{'|'.join(starts)}))(?=[A-Za-z\x{{C0}}-\x{{24F}}]\S*+\s++\S)" + words(3)[1:] + r"[^\n]*+(?<=[^\d\s])\z"


def needed(pattern: str) -> str:
    """The longest run of letters that stands in all matches, in lower case."""
    return max(re.findall("[A-Za-z]+", re.sub(r"\(\?=.*|\\b|\([^)]*\)|\[[^]]*\]", " ", pattern)), key=len).lower()


def java_words(pattern: str) -> str:
    """``\\b`` as an edge of ASCII word characters, which is what other engines mean by it: the first one stands
    before a letter, others after one."""
    head, *rest = pattern.split(r"\b")
    return head + r"(?<![A-Za-z0-9_])" + r"(?![A-Za-z0-9_])".join(rest)


def cased(test) -> str:
    """Character class of the Basic Multilingual Plane's characters that pass a test, as ranges."""
    found = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and test(chr(c))]
    ranges, start = [], None
    for a, b in zip(found, [*found[1:], None], strict=True):
        start = a if start is None else start
        if b != a + 1:
            ranges.append(rf"\x{{{start:X}}}-\x{{{a:X}}}")
            start = None
    return f"[{''.join(ranges)}]"


#: Characters that are lower case and have an upper case; those that are not their own upper case.
LOWER = cased(lambda c: c.lower() == c and c.upper() != c)
NOT_UPPER = cased(lambda c: c.upper() != c)
