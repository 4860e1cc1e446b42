"""Inputs with planted artefacts: one definition, rendered for Spark SQL and for DuckDB.

The raw tables hold hardly any of what the cleaner removes, so queries run on ``documents`` with lines
planted among its own by plain arithmetic on document and line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.functions.headings import ORDINAL_WORDS

#: For k = (doc_id * 31 + i * 7) % 40: SQL expressions of the lines that stand for base line b, number i.
_B, _I = "b", "CAST(i AS {S})"
RECIPE: dict[int, list[str]] = {
    0: [_B, "''", _I, "''"],
    1: [_B, _I],
    2: [_B, "CASE doc_id % 4 WHEN 0 THEN concat('- ', {I}, ' -') WHEN 1 THEN concat('Page ', {I}, ' of 99') WHEN 2 THEN concat('| ', {I}, ' |') ELSE '| xiv |' END"],
    3: [_B, "concat('— ', {I}, ' —')"],
    4: [_B, "concat(substring(b, 1, 20), ' ', CASE doc_id % 3 WHEN 0 THEN '.....' WHEN 1 THEN '___' ELSE '---' END, ' ', {I})"],
    5: [_B, "CASE doc_id % 3 WHEN 0 THEN concat('[', CAST(i % 100 AS {S}), ']') WHEN 1 THEN concat(CAST(i % 100 AS {S}), '.') ELSE '†' END"],
    6: [_B, "CASE doc_id % 3 WHEN 0 THEN '•' WHEN 1 THEN '-' ELSE '|' END"],
    7: [_B, "'© 2024 Example Co'", "'All rights reserved.'", "'ISBN: 978-0-00-000000-0'", "'see notice © 2024 here'"],
    8: [_B, "'doi: 10.1/x'", "'Elsevier Ltd'"],
    9: [_B, "'12 CITATIONS'", "'SEE PROFILE'"],
    10: [_B, "CASE doc_id % 2 WHEN 0 THEN concat('https://example.org/', {I}) ELSE concat('a', {I}, '@example.org') END"],
    11: [_B, "'#%&^^~~++=='", "'#%& ^^ ~~ ++ =='", "'#%& ^^ ~~ 7'"],
    12: [_B, "'w i t h a r e'"],
    13: ["'Short head'", _B],
    14: ["'Short head'", _B],
    15: ["'Short head'", _B],
    16: ["'Short head'", _B],
    18: ["concat(b, ' left-')", "'right of it'"],
    19: ["concat(b, ' docu-')", "'men-'", "'tation here'"],
    20: ["concat(b, ' left-')", "'Right of it'"],
    21: ["concat(b, ' and so')", "'it goes on'", "'then a list,'", "'Ends here.'"],
    22: [_B, "''", "''", "''", "''"],
    23: ["concat('ﬁ ﬃ “', b, '”–— … a\u00a0b\u200bc\ufeffd\u2009e')"],
    24: ["concat('a', chr(12), b, chr(7), 'x', chr(127))"],
    25: ["'See discussions, stats, and author profiles for this'", "'first row'", "'second row'", "'The user has requested enhancement of it'", "'SEE PROFILE'", "''", _B],
    26: ["'See discussions, stats, and author profiles for that'", "'one row'", "'another row'", "''", "''", _B],
    27: ["'See discussions, stats, and author profiles once'", "'See discussions, stats, and author profiles twice'", "'All content following this page was uploaded by x'", "'3 authors:'", _B],
    28: [_B, "concat('Custom ', {I})"],
    29: ["concat(b, chr(13))", "concat('© 2023 Somebody', chr(13))"],
    30: ["concat('Er ging fiir ihn iiber das grobe Feld, üfiir aber wiiste nicht, dafiir konnen. ', b)"],
    31: ["concat('#      %  x       y  ~ ', b, '   ; z      &')"],
}
HEADER = "'Running Header of Document '"


def _lines(engine: str) -> str:
    text = {"spark": "string", "duckdb": "varchar"}[engine]
    array = {"spark": "array({})", "duckdb": "[{}]"}[engine]
    fill = lambda e: e.replace("{I}", _I).replace("{S}", text)
    cases = " ".join(f"WHEN {k} THEN {array.format(', '.join(map(fill, v)))}" for k, v in RECIPE.items())
    head = f"CASE WHEN i % 3 = 0 AND doc_id % 5 = 0 THEN {array.format(fill('concat(' + HEADER + ', CAST(doc_id AS {S}))'))} WHEN i % 3 = 0 AND doc_id % 5 = 1 THEN {array.format(fill('concat(' + HEADER + ', CAST(doc_id AS {S}), chr(CAST(97 + i % 26 AS int)))'))} ELSE {array.format('').replace('()', '()')} END"
    if engine == "spark":
        head = head.replace("ELSE array() END", "ELSE cast(array() as array<string>) END")
    return f"concat({head}, CASE (doc_id * 31 + i * 7) % 40 {cases} ELSE {array.format(_B)} END)"


def dirty_sql(engine: str) -> str:
    """SQL of dirty_docs(doc_id, text) over ``documents``, and of dirty_lines(doc_id, pos, line)."""
    if engine == "spark":
        return f"""
        WITH base AS (SELECT doc_id, CAST(p.i AS bigint) AS i, p.b FROM documents LATERAL VIEW posexplode(split(text, '\\n')) p AS i, b)
        SELECT doc_id, array_join(flatten(transform(array_sort(collect_list(struct(i, {_lines(engine)} AS ls))), x -> x.ls)), '\\n') AS text
        FROM base GROUP BY doc_id"""
    return f"""
    base AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    dirty_docs AS (SELECT doc_id, array_to_string(flatten(list({_lines(engine)} ORDER BY i)), chr(10)) AS text FROM base GROUP BY doc_id),
    norm AS (SELECT doc_id, {{norm}} AS text FROM dirty_docs)"""


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``, dealt by doc_id. A file of one row group is read by one task: work on the texts belongs behind the exchange, and
    grouping by doc_id then needs no other."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark, sf_dir).createOrReplaceTempView("documents")
    return spark.sql(dirty_sql("spark"))


# -- tables derived from documents, a row each, in SQL that both engines read -------------------

_PRINTABLE = {"spark": "regexp_replace(coalesce(text, ''), '[^ -~\\n]', ' ')", "duckdb": "regexp_replace(coalesce(text, ''), '[^ -~\\n]', ' ', 'g')"}
_ID = "CAST(doc_id AS {S})"


_FILES = [  # path, length, body; {T}: the document's printable text
    ("concat('/b/a', {I}, '#t.pdf')", "1000 + doc_id", "concat('%PDF-1.7 ', {T}, ' /Filter /DCTDecode /Im1 3 0 R /Im2 4 0 R /XObject << /Subtype /Image')"),
    ("concat('/b/scan', {I}, '.PDF')", "30000000", "concat('%PDF-1.4 plain ', {I})"),
    ("concat('/b/x_y#z', {I}, '#2.epub')", "6000000", "concat('PK', chr(3), chr(4), 'mimetype', {T})"),
    ("concat('/b/plain', {I}, '.txt')", "length({T})", "{T}"),
    ("concat('/b/named', {I}, '.pdf')", "500", "{T}"),
    ("concat('/b/noise', {I}, '.bin')", "64", "concat(chr(1), chr(2), chr(3), chr(4), chr(5), 'ab')"),
    ("concat('/b/empty', {I}, '.txt')", "0", "''"),
    ("concat('/b/large', {I}, '.txt')", "1048577", "{T}"),
    ("concat('/b/edge', {I}, '.txt')", "1048576", "{T}"),
    ("concat('/b/odd', {I}, '.pdf')", "doc_id * 100003", "concat('%PDF-x.y ', {T})"),
    ("concat('/b/c_d#e', {I}, '.pdf')", "n_chars * 20000", "concat('%PDF-1.', CAST(doc_id % 8 AS {S}), ' stream', chr(10), 'xx JFIF /Image', {I}, ' 1 0 R', chr(12), {T}, chr(12), substring({T}, 1, CAST(doc_id % 300 AS int)))"),
    ("concat('/b/.hidden', {I})", "10", "concat('hidden ', {T})"),
]
_NAMES = [
    "concat('/in/a', {I}, '#t.pdf')", "concat('/in/Jane_Doe#A_Long_Title#', {I}, '.txt')", "concat('plain', {I}, '.pdf')", "concat('x/a_b#c_d', {I}, '.epub')", "concat('/in/a#b#c#d', {I}, '.txt')",
    "concat('#t', {I}, '.pdf')", "concat('/in/no ext', {I})", "concat('/in/', repeat('a', 101), '#t', {I}, '.txt')", "concat('/in/w', {I}, '#', repeat('t', 201), '.txt')",
    "concat('/in/we<ird>: na|me?', {I}, '.txt')", "concat('a#b#c_', {I}, '.tar.gz')", "concat('/in/', replace(replace(substring({T}, 1, 25), '/', ' '), chr(10), ' '), '#', {I}, '.txt')",
]
_START = "substring(coalesce(text, ''), 1, 40)"
_ROMAN = "concat(split_part(',X,XX,XXX,XL,L,LX,LXX,LXXX,XC,C', ',', CAST(floor((doc_id % 100 + 1) / 10) AS int) + 1), split_part(',I,II,III,IV,V,VI,VII,VIII,IX', ',', CAST((doc_id % 100 + 1) % 10 AS int) + 1))"
_WORD = f"split_part('{','.join(ORDINAL_WORDS.split())}', ',', CAST(doc_id % 50 + 1 AS int))"
#: Titles: level, template, values as JSON.
TITLES = [
    (_ROMAN, 1, "{roman-number}", f"concat('{{\"roman-number\":\"', {_ROMAN}, '\"}}')"),
    ("concat('Kapitel ', {I})", 1, "Kapitel {decimal-number}", "concat('{\"decimal-number\":\"', {I}, '\"}')"),
    ("concat(CAST(doc_id % 28 + 1 AS {S}), '. Januar 1910 Berlin')", 2, "{long-date} {place}", "concat('{\"long-date\":\"', CAST(doc_id % 28 + 1 AS {S}), '. Januar 1910\",\"place\":\"Berlin\"}')"),
    (f"concat('  ', {_WORD}, ' VORTRAG ')", 2, "{german-ordinal} VORTRAG", f"concat('{{\"german-ordinal\":\"', {_WORD}, '\"}}')"),
    (f"concat('EIN TITEL ', {_ROMAN})", 3, "{title-in-capital-letters}", f"concat('{{\"title-in-capital-letters\":\"EIN TITEL ', {_ROMAN}, '\"}}')"),
    ("concat('x ', {T})", None, None, None),
]


def _derived(columns: dict[str, str], name: str, engine: str) -> str:
    text = {"spark": "string", "duckdb": "varchar"}[engine]
    fill = lambda e: e.replace("{I}", _ID).replace("{T}", _PRINTABLE[engine]).replace("{S}", text)
    return f"(SELECT {', '.join(f'{fill(e)} AS {c}' for c, e in columns.items())} FROM documents) AS {name}"


def _pick(rows: list[str]) -> str:
    return f"CASE doc_id % {len(rows)} {' '.join(f'WHEN {i} THEN {r}' for i, r in enumerate(rows))} END"


def _tables(engine: str) -> dict[str, str]:
    big = lambda e: f"CAST({e} AS bigint)"
    string = lambda v: f"'{v}'" if v is not None else "NULL"
    raw = lambda prefix, keep: f"CASE WHEN doc_id % 5 {keep} THEN concat('{prefix} ', {_START}) END"
    out = {
        "FILES": {"path": _pick([f[0] for f in _FILES]), "length": big(_pick([f[1] for f in _FILES])), "body": _pick([f[2] for f in _FILES])},
        "PDFS": {"path": "concat('p', {I})", "page_count": "CAST(doc_id % 7 * (doc_id % 3 + 1) AS int)", "sample_text": "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN repeat('x', CAST(90 + doc_id % 40 AS int)) ELSE coalesce(text, '') END", "has_images": "doc_id % 2 = 0"},
        "NAMES": {"path": _pick(_NAMES)},
        "ARTIFACTS": {"config_key": "concat('k', {I})", "cleaned_ocr": raw("co", "= 0"), "cleaned_txt": raw("ct", "<= 1"), "raw_ocr": raw("ro", "<= 2"), "raw_txt": raw("rt", "<= 3")},
        "KINDS": {"path": "concat('k', {I}, CASE WHEN doc_id % 6 < 4 THEN '.pdf' WHEN doc_id % 6 = 4 THEN '.epub' ELSE '.txt' END)", "format": "CASE WHEN doc_id % 6 < 4 THEN 'pdf' WHEN doc_id % 6 = 4 THEN 'epub' ELSE 'txt' END", "content_type": "CASE doc_id % 6 WHEN 0 THEN 'text_based' WHEN 1 THEN 'image_based' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'empty' END"},
        "TYPES": {"kind": "CASE doc_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'novel' WHEN 2 THEN 'report' ELSE coalesce(lang, 'x') END", "pattern": _START},
        "ORDINALS": {
            "roman": f"CASE WHEN doc_id % 4 = 0 THEN {_ROMAN} WHEN doc_id % 4 = 3 THEN 'IC' END",
            "decimal_": "CASE doc_id % 4 WHEN 0 THEN '3' WHEN 1 THEN concat(' ', {I}, '. x') WHEN 3 THEN 'x' END",
            "ordinal": f"CASE doc_id % 4 WHEN 0 THEN 'erster' WHEN 1 THEN 'zweiter' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 AND {_WORD} NOT LIKE '%ß%' THEN upper({_WORD}) ELSE {_WORD} END ELSE 'x' END",
            "value": "CAST(CASE doc_id % 4 WHEN 0 THEN doc_id % 100 + 1 WHEN 1 THEN doc_id WHEN 2 THEN doc_id % 50 + 1 END AS int)",
        },
        "BOOKS": {"config_key": "concat({I}, '#t')", "file_type": "CASE WHEN doc_id % 3 = 0 THEN 'pdf-ocr' ELSE 'text' END", "size": big("n_chars"), "page_count": big("doc_id % 50")},
        "MANIFESTS": {"config_key": "concat(CAST(doc_id - doc_id % 7 % 2 * 1000000 AS {S}), '#t')", "file_type": "CASE WHEN doc_id % 9 = 0 THEN 'pdf-ocr' ELSE 'text' END", "size": big("CASE WHEN doc_id % 4 <> 1 THEN n_chars END"), "page_count": big("doc_id % 50 + CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END")},
        "FORMATS": {"format": "CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'PNG' WHEN 2 THEN 'jpg' WHEN 3 THEN 'epub' WHEN 4 THEN coalesce(source, 'txt') ELSE 'bmp' END"},
        "EXTRACTED": {"config_key": "concat('k', {I})", "text": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(text, '') END", "ocr_text": f"CASE doc_id % 4 WHEN 0 THEN concat('seen ', {_START}) WHEN 1 THEN ' ' WHEN 3 THEN 'seen too' END", "file_type": "CASE doc_id % 3 WHEN 0 THEN 'pdf-text-ocr' WHEN 1 THEN 'text' ELSE 'pdf-ocr' END"},
        "TITLED": {"doc_id": "doc_id", "title": _pick([t[0] for t in TITLES]), "level": f"CAST({_pick([str(t[1] or 'NULL') for t in TITLES])} AS int)", "template": _pick([string(t[2]) for t in TITLES]), "found": _pick([t[3] or "NULL" for t in TITLES])},
    }
    return {k: _derived(v, k.lower(), engine) for k, v in out.items()}


SPARK, DUCK = _tables("spark"), _tables("duckdb")
FILES, PDFS, NAMES, ARTIFACTS = (DUCK[k] for k in ("FILES", "PDFS", "NAMES", "ARTIFACTS"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by name."""
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return spark.sql(f"SELECT * FROM {SPARK[name]}")


def lines_sql(engine: str) -> str:
    """Lines of recognised pages, a page for each document: book_id, page_no, n, text, x0, x1, mark. Headings, notes and indented lines are
    planted among the document's own."""
    text = {"spark": "string", "duckdb": "varchar"}[engine]
    base = {
        "spark": "SELECT doc_id, p.n, p.b FROM documents LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) p AS n, b",
        "duckdb": "SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS n, unnest(ls) AS b FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)",
    }[engine]
    k = "(doc_id * 7 + n * 3) % 16"
    number = f"CAST(n % 90 + 1 AS {text})"
    return f"""(SELECT CAST(doc_id % 97 AS int) AS book_id, CAST(doc_id AS int) AS page_no, CAST(n AS int) AS n,
  CASE {k} WHEN 0 THEN 'XIV' WHEN 1 THEN concat({number}, ' A note about it.') WHEN 2 THEN '** Two stars.' WHEN 3 THEN 'EIN TITEL' WHEN 4 THEN concat('§ ', {number}) WHEN 5 THEN concat(b, '-') ELSE b END AS text,
  CAST(CASE {k} WHEN 0 THEN 1200 + n % 20 WHEN 1 THEN 320 WHEN 2 THEN 320 WHEN 3 THEN 900 WHEN 6 THEN 340 + n % 4 ELSE 300 + n % 5 END AS double) AS x0,
  CAST(CASE {k} WHEN 0 THEN 1280 + n % 20 WHEN 1 THEN 1500 WHEN 2 THEN 1300 WHEN 3 THEN 1580 ELSE 2100 - n % 50 END AS double) AS x1,
  CASE {k} WHEN 1 THEN {number} WHEN 2 THEN '**' END AS mark FROM ({base}) AS l) AS t"""
