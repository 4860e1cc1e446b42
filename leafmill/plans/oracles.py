"""The cleaner's semantics in DuckDB SQL, by windows over lines. It shares pattern texts with the engine and nothing else."""

from __future__ import annotations

from leafmill.functions import patterns as P
from leafmill.plans.fixtures import dirty_sql


def _match(line: str, patterns: list[str]) -> str:
    return f"regexp_matches({line}, '{P.any_of(patterns)}')"


def _norm(text: str) -> str:
    out = f"replace({text}, chr(12), chr(10))"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]', '', 'g')"
    for old, new in {**P.LIGATURES, **P.QUOTES, **P.WIDE}.items():
        out = f"replace({out}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace({out}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    return f"regexp_replace({out}, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"


_T = "trim({}, chr(9) || chr(10) || chr(13) || ' ')"
TRIM = _T.format
DIRTY = "WITH RECURSIVE " + dirty_sql("duckdb").replace("{norm}", _norm("text"))
LINES = DIRTY + f""",
n0 AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1))::INT AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM norm)),
raw AS (SELECT *, coalesce(lag(line) OVER w, '') AS prev, coalesce(lead(line) OVER w, '') AS next, {TRIM('line')} AS t FROM n0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


def lines_that(condition: str) -> str:
    return f"{LINES} SELECT doc_id, pos, line FROM raw WHERE {condition}"


def junk(ocr: bool) -> str:
    runs, share = (3, 0.25) if ocr else (2, 0.35)
    letters = "length(regexp_replace(t, '[^ A-Za-z\\x{C0}-\\x{24F}]', '', 'g'))"
    return f"length(t) > 4 AND len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) < {runs} AND NOT regexp_matches(t, '\\d') AND {letters} / length(t)::DOUBLE < {share}"


BLANK = "({} = '')".format
PAGE = f"({_match('line', P.PAGE_NUMBER)} OR ({BLANK(TRIM('prev'))} AND {BLANK(TRIM('next'))} AND {_match('line', P.BARE_PAGE)}))"
PREDICATES = {
    "page_number": PAGE,
    "toc_leader": _match("line", P.TOC_LEADER),
    "footnote_marker": _match("line", P.FOOTNOTE),
    "orphan_bullet": _match("line", P.BULLET),
    "separator": _match("line", P.SEPARATOR),
    "boilerplate": _match("line", P.BOILERPLATE + P.COPYRIGHT + P.ACADEMIC + P.PROFILE_PAGES),
    "url": _match("line", P.URL_LINE),
    "ocr_junk": junk(False),
    "spaced_letters": f"length(t) >= 7 AND regexp_matches(t, '{P.SPACED_LETTERS}')",
}
CUSTOM = r"(?i)^custom\s+\d+"


def cleaned(ocr: bool = False, aggressive: bool = False, without: tuple[str, ...] = ()) -> str:
    """CTEs: secs, ln (lines after sections), rep, why (reasons), hy, hj (hyphens), wrapped, out (blank lines), doc."""
    preds = PREDICATES | {"ocr_junk": junk(ocr)}
    case = " ".join(f"WHEN {c} THEN '{k}'" for k, c in preds.items() if k not in without)
    thr = "greatest(2, floor(1 + sqrt(n / 30)))" if aggressive else "greatest(3, floor(2 + sqrt(n / 25)))"
    last, first = "right(line, 1)", "left(nxt, 1)"
    ends = ", ".join("'" + c.replace("'", "''") + "'" for c in P.SENTENCE_ENDS)
    more = " OR (lower(left(line, 1)) <> upper(left(line, 1)) AND left(line, 1) <> upper(left(line, 1)))" if aggressive else ""
    return f"""{LINES},
fl AS (SELECT doc_id, pos, line, {_match('line', [P.SIGNATURE])} AS sig, {_match('line', P.SECTION_END)} AS en, ({_match('line', P.SECTION_MORE)} OR t = '') AS cb, (t = '' AND pos < max(pos) OVER (PARTITION BY doc_id) AND {TRIM('next')} = '') AS gap, count(*) OVER (PARTITION BY doc_id) AS n FROM raw),
c1 AS (SELECT doc_id, pos AS i, n, (SELECT min(e.pos) FROM fl e WHERE e.doc_id = f.doc_id AND e.en AND e.pos >= f.pos AND e.pos < f.pos + 50) AS mark FROM fl f WHERE sig),
c2 AS (SELECT doc_id, i, CASE WHEN mark IS NOT NULL THEN coalesce((SELECT min(e.pos) FROM fl e WHERE e.doc_id = c1.doc_id AND NOT e.cb AND e.pos > mark), n) ELSE coalesce((SELECT min(e.pos) FROM fl e WHERE e.doc_id = c1.doc_id AND e.gap AND e.pos >= i AND e.pos < i + 30), least(i + 30, n)) END AS e FROM c1),
secs AS (SELECT c2.doc_id, c2.i, c2.e FROM c2 JOIN (SELECT doc_id, min(i) AS i FROM c2 GROUP BY doc_id) USING (doc_id, i)
  UNION ALL SELECT s.doc_id, c2.i, c2.e FROM secs s JOIN c2 ON c2.doc_id = s.doc_id AND c2.i = (SELECT min(x.i) FROM c2 x WHERE x.doc_id = s.doc_id AND x.i >= s.e)),
l1 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM fl WHERE NOT EXISTS (SELECT 1 FROM secs s WHERE s.doc_id = fl.doc_id AND fl.pos >= s.i AND fl.pos < s.e) AND NOT (pos >= n - 10 AND regexp_matches(line, '{P.TRAILING}'))),
l2 AS (SELECT doc_id, pos, line FROM l1 UNION ALL SELECT doc_id, 0, '' FROM norm WHERE doc_id NOT IN (SELECT doc_id FROM l1)),
ln AS (SELECT *, {TRIM('line')} AS t, coalesce(lag(line) OVER w, '') AS prev, coalesce(lead(line) OVER w, '') AS next, count(*) OVER (PARTITION BY doc_id) AS n FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, t FROM ln GROUP BY doc_id, t, n HAVING count(*) >= {thr} AND length(t) >= 25 AND NOT regexp_matches(t, '{P.DIGITS_ONLY}') AND NOT regexp_matches(t, '{P.NUMERIC_ONLY}') AND contains(t, ' ')),
why AS (SELECT *, CASE {case} WHEN EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = ln.doc_id AND rep.t = ln.t) THEN 'repeated' WHEN regexp_matches(line, '{CUSTOM}') THEN 'custom' END AS reason FROM ln),
hy AS (SELECT doc_id, row_number() OVER w AS p, line, ltrim(lead(line) OVER w, chr(9) || chr(13) || ' ') AS nxt FROM why WHERE reason IS NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hk AS (SELECT *, coalesce(regexp_matches(line, '[A-Za-z0-9_]-\\s*\\z') AND regexp_matches(nxt, '^[a-z\\x{{E0}}-\\x{{24F}}]'), false) AS j FROM hy),
hm AS (SELECT *, j AND (p - coalesce(max(CASE WHEN NOT j THEN p END) OVER (PARTITION BY doc_id ORDER BY p), 0)) % 2 = 1 AS glued FROM hk),
hn AS (SELECT *, coalesce(lag(glued) OVER (PARTITION BY doc_id ORDER BY p), false) AS eaten FROM hm),
hj AS (SELECT doc_id, p, CASE WHEN glued THEN regexp_replace(line, '-\\s*\\z', '') || nxt ELSE line END AS line FROM hn WHERE NOT eaten),
w1 AS (SELECT doc_id, p, {TRIM('line')} AS line FROM hj),
w2 AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w1),
w3 AS (SELECT *, CASE WHEN line <> '' AND before <> '' AND ((right(before, 1) NOT IN ({ends}) AND left(line, 1) = lower(left(line, 1)) AND left(line, 1) <> upper(left(line, 1))) OR right(before, 1) = ','{more}) THEN 0 ELSE 1 END AS fresh FROM w2),
w4 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM w3),
wrapped AS (SELECT doc_id, g, string_agg(line, ' ' ORDER BY p) AS line FROM w4 GROUP BY doc_id, g),
b1 AS (SELECT *, line = '' AS bl, g - coalesce(max(CASE WHEN line <> '' THEN g END) OVER (PARTITION BY doc_id ORDER BY g), 0) AS r, min(CASE WHEN line <> '' THEN g END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN line <> '' THEN g END) OVER (PARTITION BY doc_id) AS hi FROM wrapped),
outl AS (SELECT doc_id, g, line FROM b1 WHERE g BETWEEN lo AND hi AND (NOT bl OR r <= 2)),
doc AS (SELECT norm.doc_id, coalesce(string_agg(outl.line, chr(10) ORDER BY g), '') AS cleaned_text, count(outl.line) AS final_lines FROM norm LEFT JOIN outl USING (doc_id) GROUP BY norm.doc_id)"""


def joined(cte: str, column: str, order: str) -> str:
    """Lines of a CTE as one text for each document."""
    return f"SELECT norm.doc_id, coalesce(string_agg({cte}.{column}, chr(10) ORDER BY {cte}.{order}), '') AS text FROM norm LEFT JOIN {cte} USING (doc_id) GROUP BY norm.doc_id"


REASONS = {"page_numbers": ["page_number"], "toc_leaders": ["toc_leader"], "footnote_markers": ["footnote_marker"], "orphan_bullets": ["orphan_bullet", "separator"], "boilerplate": ["boilerplate"], "urls": ["url"], "ocr_junk": ["ocr_junk"], "spaced_letters": ["spaced_letters"], "repeated": ["repeated"], "custom": ["custom"]}


def stats() -> str:
    counts = ", ".join(f"count(*) FILTER (reason IN ({', '.join(repr(r) for r in rs)})) AS {k}" for k, rs in REASONS.items())
    return f"""{cleaned()}
SELECT why.doc_id, count(*) AS original_lines, any_value(doc.final_lines) AS final_lines,
  (SELECT count(*) FROM secs s WHERE s.doc_id = why.doc_id) AS sections_stripped,
  (SELECT count(*) FROM rep r WHERE r.doc_id = why.doc_id) AS repeated_lines,
  any_value(greatest(3, floor(2 + sqrt(n / 25))))::BIGINT AS repeat_threshold, {counts}
FROM why JOIN doc USING (doc_id) GROUP BY why.doc_id"""
