"""The cleaner's passes one after the other on Python lists: what the Spark plan is held against."""

import math
import re

from leafmill.functions import patterns as P
from leafmill.operators.repeats import fuzzy_repeats

WS = " \t\r\n"


def any_of(patterns):
    def pattern(p):
        return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p).replace(r"\z", r"\Z").replace("(?i)", "")

    compiled = [re.compile(pattern(p), (re.IGNORECASE if p.startswith("(?i)") else 0) | re.ASCII) for p in patterns]
    return lambda s: any(c.search(s) for c in compiled)


def normalize(text):
    text = text.replace("\f", "\n")
    text = "".join(c for c in text if c not in P.CONTROL)
    for old, new in {**P.LIGATURES, **P.QUOTES, **P.WIDE}.items():
        text = text.replace(old, new)
    return "".join(" " if c in P.SPACES else c for c in text if c not in P.DELETED)


def strip_sections(lines):
    starts, ends, more, trailing = any_of([P.SIGNATURE]), any_of(P.SECTION_END), any_of(P.SECTION_MORE), any_of([P.TRAILING])
    gone, sections, i = set(), 0, 0
    blank = [not x.strip(WS) for x in lines]
    while i < len(lines):
        if not starts(lines[i]):
            i += 1
            continue
        mark = next((j for j in range(i, min(i + 50, len(lines))) if ends(lines[j])), None)
        if mark is not None:
            end = mark + 1
            while end < len(lines) and (more(lines[end]) or blank[end]):
                end += 1
        else:
            end = next((j for j in range(i, min(i + 30, len(lines))) if blank[j] and j + 1 < len(lines) and blank[j + 1]), min(i + 30, len(lines)))
        gone |= set(range(i, end))
        sections, i = sections + 1, end
    gone |= {k for k in range(max(0, len(lines) - 10), len(lines)) if trailing(lines[k])}
    return [x for k, x in enumerate(lines) if k not in gone] or [""], sections


def reasons(lines, aggressive=False, ocr=False, custom=()):
    n = len(lines)
    threshold = max(2, int(1 + math.sqrt(n / 30))) if aggressive else max(3, int(2 + math.sqrt(n / 25)))
    trimmed = [x.strip(WS) for x in lines]
    numeric = any_of([P.DIGITS_ONLY, P.NUMERIC_ONLY])
    repeated = {t for t in trimmed if trimmed.count(t) >= threshold and len(t) >= 25 and " " in t and not numeric(t)}
    fuzzy = fuzzy_repeats(lines, threshold) if aggressive else [False] * n
    tests = [(n, any_of(p)) for n, p in (("toc_leader", P.TOC_LEADER), ("footnote_marker", P.FOOTNOTE), ("orphan_bullet", P.BULLET), ("separator", P.SEPARATOR), ("boilerplate", P.BOILERPLATE + P.COPYRIGHT + P.ACADEMIC + P.PROFILE_PAGES), ("url", P.URL_LINE))]
    page, bare, spaced = any_of(P.PAGE_NUMBER), any_of(P.BARE_PAGE), any_of([P.SPACED_LETTERS])
    own = any_of([f"(?i){p}" for p in custom])
    out = []
    for i, (line, t) in enumerate(zip(lines, trimmed, strict=True)):
        alone = (i == 0 or not trimmed[i - 1]) and (i + 1 == n or not trimmed[i + 1])
        words = len(re.findall("[A-Za-z]{3,}", t))
        letters = sum(c == " " or "a" <= c.lower() <= "z" and c.isascii() or "À" <= c <= "ɏ" for c in t)
        junk = len(t) > 4 and words < (3 if ocr else 2) and not re.search("[0-9]", t) and letters / len(t) < (0.25 if ocr else 0.35)
        found = [("page_number", page(line) or alone and bare(line))] + [(k, f(line)) for k, f in tests]
        found += [("ocr_junk", junk), ("spaced_letters", len(t) >= 7 and spaced(t)), ("repeated", t in repeated), ("fuzzy_repeated", fuzzy[i]), ("custom", bool(custom) and own(line))]
        out.append(next((k for k, hit in found if hit), None))
    return out, threshold, len(repeated)


def hyphens(lines):
    out, i = [], 0
    while i < len(lines):
        m = re.search(r"([A-Za-z0-9_]+)-[ \t\r]*\Z", lines[i])
        nxt = lines[i + 1].lstrip(" \t\r") if i + 1 < len(lines) else ""
        if m and nxt and re.match("[a-zà-ɏ]", nxt):
            out.append(lines[i][: m.start()] + m[1] + nxt)
            i += 2
        else:
            out.append(lines[i])
            i += 1
    return out


def rewrap(lines, aggressive=False):
    out = []
    for line in (x.strip(WS) for x in lines):
        if line and out and out[-1]:
            last, first = out[-1][-1], line[0]
            if last not in P.SENTENCE_ENDS and first == first.lower() != first.upper() or last == "," or aggressive and first != first.upper():
                out[-1] += " " + line
                continue
        out.append(line)
    return out


def collapse(lines):
    out = []
    for line in lines:
        if line or out[-2:] != ["", ""]:
            out.append(line)
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return out


def clean(text, aggressive=False, ocr=False, custom=()):
    lines, sections = strip_sections(normalize(text).split("\n"))
    why, threshold, repeated = reasons(lines, aggressive, ocr, custom)
    kept = [x for x, r in zip(lines, why, strict=True) if r is None]
    final = collapse(rewrap(hyphens(kept), aggressive))
    return "\n".join(final), {"original_lines": len(lines), "final_lines": len(final), "sections_stripped": sections, "repeat_threshold": threshold, "repeated_lines": repeated, "removed": len(lines) - len(kept)}
