"""Registered queries of the cleaning engine: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import files as N
from leafmill.functions import lines as L
from leafmill.functions import patterns as P
from leafmill.functions import text as T
from leafmill.operators import clean as C
from leafmill.plans import fixtures as X
from leafmill.plans import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CUSTOM = (O.CUSTOM.removeprefix("(?i)"),)
OPTIONS = L.CleanOptions(extra_patterns=CUSTOM)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dirty_docs(spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- characters and lines -------------------------------------------------------------------


@query(f"{O.DIRTY} SELECT doc_id, text FROM norm")
def normalize_unicode(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_unicode(F.col("text")).alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line, prev, next: neighbours come from the array, so nothing is shuffled."""
    lines = C.split_lines(T.normalize_unicode(F.col("text")))
    near = T.let(lines, lambda a: F.transform(a, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(a, i - 1), F.lit("")).alias("prev"), F.coalesce(F.get(a, i + 1), F.lit("")).alias("next"))))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(near).alias("pos", "x")).select("doc_id", "pos", "x.*")


@query(f"{O.LINES} SELECT doc_id, pos, line FROM raw")
def explode_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", "line")


def _line_query(name: str, test: Callable[[Column, Column, Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _lines(spark, sf_dir).where(test(F.col("line"), F.col("prev"), F.col("next"))).select("doc_id", "pos", "line")

    QUERIES[name], ORACLES[name] = run, O.lines_that(sql)


for _name, _test, _sql in (
    ("page_numbers", L.is_page_number, O.PREDICATES["page_number"]),
    ("toc_leaders", lambda x, p, n: L.is_toc_leader(x), O.PREDICATES["toc_leader"]),
    ("footnote_markers", lambda x, p, n: L.is_footnote_marker(x), O.PREDICATES["footnote_marker"]),
    ("orphan_bullets", lambda x, p, n: L.is_orphan_bullet(x), O.PREDICATES["orphan_bullet"]),
    ("separators", lambda x, p, n: L.is_separator(x), O.PREDICATES["separator"]),
    ("boilerplate", lambda x, p, n: L.is_boilerplate(x), O.PREDICATES["boilerplate"]),
    ("standalone_urls", lambda x, p, n: L.is_url(x), O.PREDICATES["url"]),
    ("ocr_junk_pdf", lambda x, p, n: L.is_ocr_junk(x, False), O.junk(False)),
    ("ocr_junk_ocr", lambda x, p, n: L.is_ocr_junk(x, True), O.junk(True)),
    ("spaced_letters", lambda x, p, n: T.is_spaced(x), O.PREDICATES["spaced_letters"]),
    ("custom_patterns", lambda x, p, n: F.regexp_like(x, F.lit(O.CUSTOM)), f"regexp_matches(line, '{O.CUSTOM}')"),
):
    _line_query(_name, _test, _sql)


# -- sections, repeats, reasons -------------------------------------------------------------


def _raw(column: str = "text") -> Column:
    return C.split_lines(T.normalize_unicode(F.col(column)))


@query(f"{O.cleaned()} SELECT doc_id, i AS first, e::INT AS \"end\" FROM secs")
def sections(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.let(_raw(), C.sections)).alias("s")).select("doc_id", "s.first", "s.end")


@query(f"{O.cleaned()} SELECT doc_id, pos::INT AS pos, line FROM ln")
def section_free_lines(spark, sf_dir):
    return C.line_table(_docs(spark, sf_dir)).select("doc_id", F.posexplode("_doc.lines").alias("pos", "line"))


@query(f"{O.cleaned()} SELECT doc_id, any_value(n) AS lines, any_value(greatest(3, floor(2 + sqrt(n / 25))))::INT AS normal, any_value(greatest(2, floor(1 + sqrt(n / 30))))::INT AS aggressive FROM ln GROUP BY doc_id")
def repeat_threshold(spark, sf_dir):
    n = F.size("_doc.lines")
    return C.line_table(_docs(spark, sf_dir)).select("doc_id", n.cast("long").alias("lines"), L.repeat_threshold(n, False).alias("normal"), L.repeat_threshold(n, True).alias("aggressive"))


@query(f"{O.cleaned()} SELECT doc_id, t AS line FROM rep")
def repeated_lines(spark, sf_dir):
    return C.line_table(_docs(spark, sf_dir)).select("doc_id", F.explode("_doc.repeated").alias("line"))


@query(f"{O.cleaned()} SELECT doc_id, pos::INT AS pos, line, reason FROM why")
def drop_reasons(spark, sf_dir):
    both = C.line_table(_docs(spark, sf_dir), OPTIONS, finish=lambda x: F.zip_with(x["lines"], x["reasons"], lambda a, b: F.struct(a.alias("line"), b.alias("reason"))))
    return both.select("doc_id", F.posexplode("_doc").alias("pos", "x")).select("doc_id", "pos", "x.*")


@query(f"{O.cleaned()} SELECT coalesce(reason, 'kept') AS reason, count(*) AS lines FROM why GROUP BY 1")
def drop_reason_counts(spark, sf_dir):
    return C.line_table(_docs(spark, sf_dir), OPTIONS, finish=lambda x: x["reasons"]).select(F.explode("_doc").alias("r")).groupBy(F.coalesce("r", F.lit("kept")).alias("reason")).agg(F.count("*").alias("lines"))


@query()
def fuzzy_repeats(spark, sf_dir):
    """Order-dependent groups; tested against a sequential model."""
    found = C.line_table(_docs(spark, sf_dir), L.CleanOptions(aggressive=True), finish=lambda x: x["fuzzy"])
    at = F.filter(F.sequence(F.lit(0), F.size("_doc") - 1), lambda i: F.get(F.col("_doc"), i))
    return found.select("doc_id", at.alias("at")).select("doc_id", F.size("at").alias("lines"), F.array_join("at", ",").alias("positions"))


# -- mending --------------------------------------------------------------------------------


def _kept(spark: SparkSession, sf_dir: str, form: str = "lines") -> DataFrame:
    """Texts of the lines that stay, as they are or in another form of _doc: trimmed."""
    kept = lambda x: F.array_join(F.filter(x[form], lambda line, i: F.get(x["reasons"], i).isNull()), "\n")
    return C.line_table(_docs(spark, sf_dir), OPTIONS, finish=kept).select("doc_id", F.col("_doc").alias("text"))


@query(f"{O.cleaned()} {O.joined('hj', 'line', 'p')}")
def hyphen_rejoin(spark, sf_dir):
    return _kept(spark, sf_dir).select("doc_id", C.rejoin_hyphens(F.col("text")).alias("text"))


@query(f"{O.cleaned()} {O.joined('wrapped', 'line', 'g')}")
def rewrap(spark, sf_dir):
    return _kept(spark, sf_dir, "trimmed").select("doc_id", C.rewrap(C.rejoin_hyphens(F.col("text")), trimmed=True).alias("text"))


@query(f"{O.cleaned(aggressive=True)} {O.joined('wrapped', 'line', 'g')}".replace("greatest(2, floor(1 + sqrt(n / 30)))", "greatest(3, floor(2 + sqrt(n / 25)))"))
def rewrap_aggressive(spark, sf_dir):
    return _kept(spark, sf_dir, "trimmed").select("doc_id", C.rewrap(C.rejoin_hyphens(F.col("text")), True, trimmed=True).alias("text"))


@query(f"{O.cleaned()} SELECT doc_id, cleaned_text AS text FROM doc")
def collapse_blanks(spark, sf_dir):
    return _kept(spark, sf_dir, "trimmed").select("doc_id", C.collapse_blanks(C.rewrap(C.rejoin_hyphens(F.col("text")), trimmed=True)).alias("text"))


@query(f"{O.cleaned()} SELECT doc_id, cleaned_text FROM doc")
def clean_text(spark, sf_dir):
    return C.clean_text(_docs(spark, sf_dir), OPTIONS).select("doc_id", "cleaned_text")


@query(f"{O.cleaned(ocr=True)} SELECT doc_id, cleaned_text FROM doc")
def clean_text_ocr(spark, sf_dir):
    return C.clean_text(_docs(spark, sf_dir), L.CleanOptions(extra_patterns=CUSTOM, source="ocr")).select("doc_id", "cleaned_text")


@query()
def clean_text_aggressive(spark, sf_dir):
    """Fuzzy repeats depend on order; tested against a sequential model."""
    return C.clean_text(_docs(spark, sf_dir), L.CleanOptions(aggressive=True, extra_patterns=CUSTOM)).select("doc_id", "cleaned_text")


@query(O.stats())
def clean_stats(spark, sf_dir):
    s = C.clean_text(_docs(spark, sf_dir), OPTIONS)
    first = ["original_lines", "final_lines", "sections_stripped", "repeated_lines", "repeat_threshold"]
    return s.select("doc_id", *(F.col(f"stats.{c}") for c in first), *(F.col(f"stats.removed.{c}") for c in O.REASONS))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 't h e r e i s' ELSE 'no spaced line' END AS line, CASE WHEN doc_id % 2 = 0 THEN 'the rei' ELSE 'no spaced line' END AS joined FROM documents")
def spaced_rejoin(spark, sf_dir):
    line = F.when(F.col("doc_id") % 2 == 0, "t h e r e i s").otherwise("no spaced line")
    return _table(spark, sf_dir, "documents").select("doc_id", line.alias("line"), T.rejoin_spaced(line).alias("joined"))


# -- extraction -----------------------------------------------------------------------------

_JS = P.JS_SPACE
_DECOMPOSED = "replace(replace(text, 'é', concat('e', chr(769))), 'ä', concat('a', chr(776)))"


@query(f"SELECT doc_id, regexp_replace(replace(text, '. ', concat('.', chr(160), ' ', chr(10), chr(10))), '{_JS}{{2,}}', ' ', 'g') AS text FROM documents")
def collapse_ws(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.replace("text", F.lit(". "), F.lit(".  \n\n"))).alias("text"))


@query(f"SELECT doc_id, nfc_normalize({_DECOMPOSED}) AS text FROM documents")
def nfc(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.nfc(F.expr(_DECOMPOSED.replace("chr(769)", "'́'").replace("chr(776)", "'̈'"))).alias("text"))


@query(f"SELECT doc_id, trim(regexp_replace(nfc_normalize({_DECOMPOSED}), '{_JS}+', ' ', 'g')) AS text FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.expr(_DECOMPOSED.replace("chr(769)", "'́'").replace("chr(776)", "'̈'"))).alias("text"))


_MARKED = "SELECT doc_id, text, CASE doc_id % 4 WHEN 3 THEN 'no such marker' ELSE substring(text, 20, 12) END AS before_, CASE doc_id % 3 WHEN 2 THEN substring(text, 5, 8) ELSE substring(text, 200, 12) END AS after_ FROM documents"


@query(f"""WITH m AS ({_MARKED}), t AS (SELECT doc_id, nfc_normalize(regexp_replace(text, '{_JS}{{2,}}', ' ', 'g')) AS t, nfc_normalize(before_) AS b, nfc_normalize(after_) AS a FROM m),
s AS (SELECT *, instr(t, b) AS fnd FROM t), u AS (SELECT *, CASE WHEN fnd > 0 THEN fnd + length(b) ELSE 1 END AS st FROM s), v AS (SELECT *, instr(substring(t, st::BIGINT), a) AS rel FROM u)
SELECT doc_id, CASE WHEN b = '' OR a = '' THEN t WHEN fnd > 0 AND rel = 1 THEN t WHEN rel > 0 THEN substring(t, st::BIGINT, (rel - 1)::BIGINT) ELSE substring(t, st::BIGINT) END AS text FROM v""")
def boundary_slice(spark, sf_dir):
    X.spread(spark, sf_dir).createOrReplaceTempView("documents")
    m = spark.sql(_MARKED)
    return m.select("doc_id", T.boundary_slice(F.col("text"), F.col("before_"), F.col("after_")).alias("text"))


@query(f"WITH m AS ({_MARKED}) SELECT doc_id, trim(regexp_replace(before_, '\\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(before_, '\\s+', ' ', 'g'))) AS has FROM m")
def marker_contains(spark, sf_dir):
    _table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(_MARKED).select("doc_id", T.contains_marker(F.col("text"), F.col("before_")).alias("has"))


@query("""WITH p AS (SELECT conv_id, turn, substring(text, 3, 15) AS m, text FROM conversations),
k AS (SELECT conv_id, min(m) FILTER (turn = 1) AS b, min(m) FILTER (turn = 4) AS a FROM p GROUP BY conv_id),
f AS (SELECT p.conv_id, p.turn, b IS NOT NULL AND contains(text, b) AS s, a IS NOT NULL AND contains(text, a) AS e FROM p JOIN k USING (conv_id)),
g AS (SELECT conv_id, min(turn) FILTER (s) AS st FROM f GROUP BY conv_id), h AS (SELECT f.conv_id, min(turn) FILTER (e AND turn > st) AS en FROM f JOIN g USING (conv_id) GROUP BY f.conv_id)
SELECT f.conv_id, f.turn FROM f JOIN g USING (conv_id) JOIN h USING (conv_id) WHERE f.turn > g.st AND (h.en IS NULL OR f.turn < h.en)""")
def page_range(spark, sf_dir):
    from leafmill.operators.pages import page_range as scan

    pages = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.substring("text", 3, 15).alias("m"))
    marks = pages.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 1, F.col("m"))).alias("start_marker"), F.min(F.when(F.col("turn") == 4, F.col("m"))).alias("end_marker"))
    return scan(pages.drop("m").join(marks, "conv_id"), "conv_id", "turn", raw=True).select("conv_id", "turn")


# -- files ----------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fixture(spark, sf_dir, "FILES").withColumn("content", F.encode("body", "ISO-8859-1"))


_F = f"""WITH f AS (SELECT path, length, body, regexp_extract(path, '[^/]*\\z') AS nm, left(body, 512) AS h FROM {X.FILES}),
g AS (SELECT *, CASE WHEN length(h) = 0 THEN false ELSE length(regexp_replace(h, '[^\\x20-\\x7E\\t\\n\\r\\x{{80}}-\\x{{FF}}]', '', 'g')) / length(h)::DOUBLE > 0.7 END AS texty,
  CASE lower(regexp_extract(nm, '^.+(\\.[^.]*)\\z', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.epub' THEN 'epub' ELSE 'txt' END AS ext FROM f),
m AS (SELECT *, CASE WHEN left(body, 4) = '%PDF' THEN 'pdf' WHEN left(body, 4) = concat('PK', chr(3), chr(4)) THEN 'epub' WHEN texty THEN 'txt' END AS magic,
  CASE WHEN left(body, 4) = '%PDF' THEN 0.95::DOUBLE WHEN left(body, 4) = concat('PK', chr(3), chr(4)) THEN 0.8::DOUBLE WHEN texty THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS conf FROM g),
r AS (SELECT *, coalesce(magic, ext) AS fmt FROM m), z AS (SELECT *, length > CASE fmt WHEN 'pdf' THEN 26214400 WHEN 'epub' THEN 5242880 ELSE 1048576 END AS big FROM r)"""


@query(f"{_F} SELECT path, magic, conf AS confidence FROM z")
def magic_number(spark, sf_dir):
    c = F.col("content")
    return _files(spark, sf_dir).select("path", N.magic_format(c).alias("magic"), N.magic_confidence(c).alias("confidence"))


@query(f"{_F} SELECT path, texty AS likely_text FROM z")
def likely_text(spark, sf_dir):
    return _files(spark, sf_dir).select("path", N.is_likely_text(F.col("content")).alias("likely_text"))


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    out = _files(spark, sf_dir).select("path", "length", N.magic_format(c).alias("magic"), N.magic_confidence(c).alias("conf"), N.extension_format(F.col("path")).alias("ext"))
    out = out.withColumn("format", F.coalesce("magic", "ext"))
    return out.withColumn("big", N.exceeds_limit(F.col("format"), F.col("length")))


@query(f"{_F} SELECT path, fmt AS format, big AS exceeds FROM z")
def size_limit(spark, sf_dir):
    return _formats(spark, sf_dir).select("path", "format", F.col("big").alias("exceeds"))


@query(f"""{_F} SELECT path, fmt AS format, CASE fmt WHEN 'pdf' THEN 'application/pdf' WHEN 'epub' THEN 'application/epub+zip' ELSE 'text/plain' END AS mime,
fmt = 'pdf' AND NOT big AS is_valid, conf * CASE WHEN magic <> ext THEN 0.8 ELSE 1 END * CASE WHEN fmt = 'pdf' AND NOT big THEN 1 ELSE 0.5 END AS confidence,
concat_ws('; ', CASE WHEN big THEN 'size' END, CASE WHEN fmt <> 'pdf' THEN 'validation' END, CASE WHEN magic <> ext THEN concat('Format mismatch: magic number suggests ', magic, ', extension suggests ', ext) END) AS issues FROM z""")
def format_result(spark, sf_dir):
    """Validators of epub and text always fail, so only a PDF within its size is valid."""
    from leafmill.plans.pipeline import detect

    return detect(_files(spark, sf_dir)).select("path", "format", "mime", "is_valid", "confidence", F.concat_ws("; ", "issues").alias("issues"))


@query(f"SELECT path, CASE WHEN regexp_matches(left(body, 8), '%PDF-\\d+\\.\\d+') THEN regexp_extract(left(body, 8), '%PDF-(\\d+\\.\\d+)', 1) ELSE 'unknown' END AS version FROM {X.FILES}")
def pdf_version(spark, sf_dir):
    return _files(spark, sf_dir).select("path", N.pdf_version(F.col("content")).alias("version"))


@query(f"SELECT path, {' + '.join(f"len(regexp_extract_all(body, '{p}'))" for p in N.IMAGE_PATTERNS)} AS matches, greatest(({' + '.join(f"len(regexp_extract_all(body, '{p}'))" for p in N.IMAGE_PATTERNS)}) // 3, CASE WHEN {' + '.join(f"len(regexp_extract_all(body, '{p}'))" for p in N.IMAGE_PATTERNS)} > 0 THEN 1 ELSE 0 END) AS estimate FROM {X.FILES}")
def image_census(spark, sf_dir):
    m = N.image_matches(F.col("content"))
    return _files(spark, sf_dir).select("path", m.alias("matches"), N.image_estimate(m).alias("estimate"))


@query(f"""WITH p AS (SELECT *, least(100, length(sample_text) / least(page_count, 5) / 200 * 100) AS cov FROM {X.PDFS})
SELECT path, CASE WHEN page_count = 0 THEN 'empty' WHEN trim(sample_text) = '' OR length(sample_text) < 100 THEN CASE WHEN has_images THEN 'image_based' ELSE 'empty' END
WHEN has_images THEN CASE WHEN cov > 60 THEN 'hybrid' ELSE 'image_based' END ELSE 'text_based' END AS content_type FROM p""")
def pdf_content_type(spark, sf_dir):
    return X.fixture(spark, sf_dir, "PDFS").select("path", N.pdf_content_type(F.col("page_count"), F.col("sample_text"), F.col("has_images")).alias("content_type"))


@query(f"""SELECT path, CASE format WHEN 'pdf' THEN CASE content_type WHEN 'text_based' THEN 'pdf-text' WHEN 'image_based' THEN 'pdf-ocr' ELSE 'pdf-text-ocr' END WHEN 'epub' THEN 'epub' ELSE 'text' END AS strategy,
CASE format WHEN 'pdf' THEN CASE content_type WHEN 'text_based' THEN 'text' WHEN 'image_based' THEN 'pdf-ocr' ELSE 'pdf-text-ocr' END WHEN 'epub' THEN 'epub' ELSE 'text' END AS manifest FROM {X.DUCK['KINDS']}""")
def file_type(spark, sf_dir):
    return X.fixture(spark, sf_dir, "KINDS").select("path", N.strategy(F.col("format"), F.col("content_type")).alias("strategy"), N.manifest_file_type(F.col("path"), F.col("content_type")).alias("manifest"))


_NM = f"""WITH a AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]*\\z'), '^(.+)\\.[^.]*\\z', '\\1') AS s FROM {X.NAMES}),
b AS (SELECT *, regexp_matches(s, '^([^#]+)#([^#]+)(#([^#]+))?\\z') AS fits, string_split(s, '#') AS ps FROM a),
c AS (SELECT path, s, replace(CASE WHEN fits THEN ps[1] ELSE 'Unknown' END, '_', ' ') AS author, left(replace(CASE WHEN fits THEN ps[2] ELSE s END, '_', ' '), 200) AS title, CASE WHEN fits THEN replace(ps[3], '_', ' ') END AS book_index FROM b)"""


@query(f"{_NM} SELECT path, author, title, book_index, length(author) <= 100 AS is_valid FROM c")
def filename_metadata(spark, sf_dir):
    return X.fixture(spark, sf_dir, "NAMES").select("path", N.name_parts(F.col("path")).alias("p")).select("path", "p.*")


@query(f"{_NM} SELECT path, CASE WHEN author <> '' AND title <> '' THEN concat_ws('#', author, title, book_index) END AS config_key, concat(CASE WHEN author <> '' AND title <> '' THEN concat_ws('#', author, title, book_index) END, '.yaml') AS config_file FROM c".replace("concat(CASE", "(CASE").replace("END, '.yaml')", "END || '.yaml')"))
def config_key(spark, sf_dir):
    key = N.config_key(N.name_parts(F.col("path")))
    return X.fixture(spark, sf_dir, "NAMES").select("path", key.alias("config_key"), F.concat(key, F.lit(".yaml")).alias("config_file"))


@query(f"{_NM} SELECT path, author || '#' || title || CASE WHEN coalesce(book_index, '') = '' OR trim(book_index) = '' THEN '' ELSE '[#' || book_index || ']' END || CASE WHEN coalesce(book_index, '') = '' THEN '[#]' ELSE '' END || '-T0.md' AS name FROM c")
def output_filename(spark, sf_dir):
    return X.fixture(spark, sf_dir, "NAMES").select("path", N.output_name(N.name_parts(F.col("path")), "T0", ".md").alias("name"))


@query("SELECT page_id, left(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g'), 255) AS name, regexp_matches(url, '^[a-zA-Z0-9_\\-#\\s.]+\\z') AS plain FROM pages")
def sanitize_filename(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", N.sanitize_name(F.col("url")).alias("name"), N.is_plain_name(F.col("url")).alias("plain"))


@query("SELECT doc_id, CASE WHEN n_chars * 37 // 60000 > 0 THEN concat(n_chars * 37 // 60000, 'm ', n_chars * 37 // 1000 % 60, 's') ELSE concat(n_chars * 37 // 1000, 's') END AS took FROM documents")
def duration_format(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", N.duration(F.col("n_chars") * 37).alias("took"))


@query(f"SELECT config_key, coalesce(cleaned_ocr, cleaned_txt, raw_ocr, raw_txt) AS text FROM {X.ARTIFACTS}")
def best_artifact(spark, sf_dir):
    from leafmill.sources.sinks import best_text

    wide = X.fixture(spark, sf_dir, "ARTIFACTS")

    def long(stage: str) -> DataFrame:
        both = (F.struct(F.lit(source).alias("source"), F.col(f"{stage}_{source}").alias("text")) for source in ("ocr", "txt"))
        return wide.select("config_key", F.inline(F.array(*both)))

    return best_text(wide.select("config_key"), long("raw"), long("cleaned"))


# -- noise, misread words, removal ----------------------------------------------------------


def _noise_sql(text: str) -> str:
    for p, r in P.NOISE:
        text = f"regexp_replace({text}, '{p}', '{r.replace('$', chr(92))}', 'g')"
    return f"trim({text}, chr(9) || chr(10) || chr(13) || ' ')"


@query(f"{O.DIRTY} SELECT doc_id, {_noise_sql('text')} AS text FROM norm")
def ocr_garbage(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.remove_noise(T.normalize_unicode(F.col("text"))).alias("text"))


def _umlaut_sql(text: str) -> str:
    for p, r in P.UMLAUTS:
        if "(?=" not in p:  # RE2 knows no look-ahead; the planted lines don't have that word
            text = f"regexp_replace({text}, '(?i){p}', '{r}', 'g')"
    for p, r in P.UMLAUTS_INSIDE:
        text = f"regexp_replace({text}, '{p}', '{r.replace('$', chr(92))}', 'g')"
    return text


def _umlaut_count(text: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '{i}{p}'))" for p, i in [(p, "(?i)") for p, _ in P.UMLAUTS if "(?=" not in p] + [(p, "") for p, _ in P.UMLAUTS_INSIDE])


@query(f"{O.DIRTY} SELECT doc_id, {_umlaut_sql('text')} AS text, {_umlaut_count('text')} AS corrections FROM norm")
def umlaut_fix(spark, sf_dir):
    t = T.normalize_unicode(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.fix_umlauts(t).alias("text"), T.count_umlauts(t).alias("corrections"))


_REMOVALS = ["/the [a-z]+ of/", "[0-9]{2,}", "(unclosed", "und"]


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'the [a-z]+ of', '', 'g'), '[0-9]{2,}', '', 'g'), 'und', '', 'g') AS text FROM documents")
def text_removal(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.remove_patterns(F.col("text"), T.valid_patterns(spark, _REMOVALS)).alias("text"))


@query(f"SELECT DISTINCT pattern FROM {X.DUCK['TYPES']} WHERE kind <> 'default'")
def pattern_union(spark, sf_dir):
    """For an unknown kind of book: the patterns of all kinds but the default, each once."""
    return X.fixture(spark, sf_dir, "TYPES").where("kind <> 'default'").select("pattern").distinct()


# -- recognised pages -----------------------------------------------------------------------

_LINES = X.lines_sql("duckdb")
LEVELS = [[{"pattern": "{roman-number}"}, {"pattern": "{title-in-capital-letters}", "multiple_lines": True}], [{"pattern": "§ {decimal-number}"}], []]
OFFSETS = {"paragraph-start": 40, "footnote-start": {"expected_x0": 20, "tolerance": 5}}


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as pages of books; a raised mark has symbols of its own."""
    _table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    symbols = F.when(F.col("mark").isNotNull(), F.transform(F.split("mark", "(?!^)"), lambda c: F.struct(c.alias("text"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), F.lit(40.0).alias("base_y1")))).otherwise(F.array(F.struct(F.lit("A").alias("text"), F.lit(0.0).alias("y0"), F.lit(38.0).alias("y1"), F.lit(40.0).alias("base_y1"))))
    one = F.struct("text", F.col("x0").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.col("x1").cast("double").alias("x1"), F.lit(40.0).alias("y1"), symbols.alias("symbols"))
    return spark.sql(f"SELECT * FROM {X.lines_sql('spark')}").select(F.col("book_id").cast("long"), "page_no", "n", one.alias("line"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ocr_lines(spark, sf_dir).groupBy("book_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    paragraphs = F.array(F.struct(F.transform("ls", lambda x: x["line"]).alias("lines")))
    from leafmill.functions.structure import flatten_lines

    return pages.select("book_id", "page_no", flatten_lines(paragraphs).alias("lines"))


@query(f"SELECT book_id, page_no, string_agg(text, ' / ' ORDER BY n) AS lines FROM {_LINES} GROUP BY 1, 2")
def flatten_lines(spark, sf_dir):
    return ocr_pages(spark, sf_dir).select(F.col("book_id").cast("int"), "page_no", F.array_join(F.transform("lines", lambda x: x["text"]), " / ").alias("lines"))


@query(f"SELECT book_id, page_no, n, mark AS footnote FROM {_LINES}")
def superscript_footnote(spark, sf_dir):
    from leafmill.functions.structure import superscript_start

    found = superscript_start(F.col("line.symbols"), F.col("line.y1") - F.col("line.y0"))
    return ocr_lines(spark, sf_dir).select(F.col("book_id").cast("int"), "page_no", "n", found.alias("footnote"))


@query(f"SELECT book_id, page_no, n, CASE WHEN mark IS NOT NULL THEN 'footnote-start' WHEN x0 BETWEEN 295 AND 305 THEN 'paragraph-text' WHEN x0 BETWEEN 335 AND 345 THEN 'paragraph-start' ELSE 'paragraph-text' END AS kind FROM {_LINES}")
def line_type(spark, sf_dir):
    from leafmill.functions.structure import line_type as kind, superscript_start

    metrics = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(a).alias("min_x0"), F.lit(b).alias("max_x0")) for t, a, b in (("paragraph-text", 295.0, 305.0), ("paragraph-start", 335.0, 345.0))))
    mark = superscript_start(F.col("line.symbols"), F.col("line.y1") - F.col("line.y0"))
    return ocr_lines(spark, sf_dir).select(F.col("book_id").cast("int"), "page_no", "n", kind(F.col("line.x0"), mark, metrics).alias("kind"))


@query(f"SELECT book_id, page_no, n, CASE WHEN regexp_matches(text, '^(\\d+|[*]+)\\s*[^\\n\\r]+\\z') THEN concat('[^', regexp_extract(text, '^(\\d+|[*]+)\\s*([^\\n\\r]+)\\z', 1), ']: ', regexp_extract(text, '^(\\d+|[*]+)\\s*([^\\n\\r]+)\\z', 2)) END AS note FROM {_LINES}")
def footnote_line(spark, sf_dir):
    from leafmill.functions.structure import footnote_line as note

    return ocr_lines(spark, sf_dir).select(F.col("book_id").cast("int"), "page_no", "n", note(F.col("line.text")).alias("note"))


@query(f"SELECT book_id, page_no, n, abs((x0 + x1) / 2 - 1240) <= 100 AND x1 - x0 <= 1800 * 0.99 AS centred FROM {_LINES}")
def centered_line(spark, sf_dir):
    from leafmill.functions.headings import is_centred

    return ocr_lines(spark, sf_dir).select(F.col("book_id").cast("int"), "page_no", "n", is_centred(F.col("line.x0"), F.col("line.x1"), F.lit(1800.0)).alias("centred"))


@query(f"SELECT roman, decimal_, ordinal, value FROM {X.DUCK['ORDINALS']}")
def ordinal_value(spark, sf_dir):
    from leafmill.functions.headings import ordinal_value as value

    return X.fixture(spark, sf_dir, "ORDINALS").select("roman", "decimal_", "ordinal", value(F.col("roman"), F.col("decimal_"), F.col("ordinal")).alias("value"))


_BOOK = "concat('# Title\n\n', text, '\n\n# FUSSNOTEN\n\n[M] first note\n[T]second\n\nthird')"


@query("WITH l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, trim(unnest(ls), chr(9) || chr(10) || chr(13) || ' ') AS x FROM (SELECT doc_id, string_split(string_split('# Title' || chr(10) || chr(10) || text || chr(10) || chr(10) || '# FUSSNOTEN', '# FUSSNOTEN')[1], chr(10)) AS ls FROM documents)) SELECT doc_id, string_agg(CASE WHEN starts_with(x, '#') THEN x ELSE array_to_string(string_split_regex(x, '\\s+')[1:5], ' ') END, '|' ORDER BY i) AS outline FROM l WHERE x <> '' GROUP BY doc_id")
def outline(spark, sf_dir):
    from leafmill.functions.structure import outline as lines

    book = F.concat(F.lit("# Title\n\n"), F.col("text"), F.lit("\n\n# FUSSNOTEN\n\n[M] first note"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines(book), "|").alias("outline"))


@query("SELECT doc_id, concat('first note|second ', doc_id, '|third') AS notes FROM documents")
def footnote_list(spark, sf_dir):
    from leafmill.functions.structure import footnote_list as notes

    text = F.concat(F.lit("\n\n# FUSSNOTEN\n\n[M] first note\n[T]second "), F.col("doc_id").cast("string"), F.lit("\n\n third \n[T] "))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(notes(text), "|").alias("notes"))


@query()
def x0_clusters(spark, sf_dir):
    """Order-dependent groups of left edges with their types; tested against the sequential model."""
    from leafmill.functions.layout import edge_metrics

    return ocr_pages(spark, sf_dir).select("book_id", "page_no", F.explode(edge_metrics(F.col("lines"), OFFSETS)).alias("m")).select("book_id", "page_no", "m.*")


@query()
def page_structure(spark, sf_dir):
    from leafmill.operators.ocr import structure_pages

    return structure_pages(ocr_pages(spark, sf_dir), LEVELS, OFFSETS).select("book_id", "page_no", "body", "footnotes")


@query()
def book_assembly(spark, sf_dir):
    from leafmill.operators.ocr import assemble_books, structure_pages

    return assemble_books(structure_pages(ocr_pages(spark, sf_dir), LEVELS, OFFSETS))


TEMPLATES = [["{roman-number}", "Kapitel {decimal-number}"], ["{long-date} {place}", "{german-ordinal} VORTRAG"], ["{title-in-capital-letters}"]]


@query(f"SELECT doc_id, level, template, found FROM {X.DUCK['TITLED']}")
def header_match(spark, sf_dir):
    """Level, template and captured values of a title in each document."""
    from leafmill.functions.headings import heading_level

    found = X.fixture(spark, sf_dir, "TITLED").select("doc_id", heading_level(F.col("title"), TEMPLATES).alias("x"))
    return found.select("doc_id", "x.level", "x.template", F.to_json("x.values").alias("found"))


# -- sources, sinks, manifests --------------------------------------------------------------


@query(f"SELECT path, concat('[EPUB Content from ', regexp_extract(path, '[^/]*\\z'), ']', chr(10), chr(10), 'This is placeholder EPUB text.') AS text FROM {X.FILES} WHERE lower(path) LIKE '%.epub'")
def epub_text(spark, sf_dir):
    from leafmill.sources.files import epub_text as placeholder

    return placeholder(_files(spark, sf_dir).where(N.extension(F.col("path")) == ".epub"))


@query(f"SELECT path, regexp_extract(path, '[^/]*\\z') AS name, length, CASE lower(regexp_extract(path, '\\.[^./]*\\z')) WHEN '.pdf' THEN 'pdf' WHEN '.epub' THEN 'epub' WHEN '.txt' THEN 'txt' END AS format, CASE lower(regexp_extract(path, '\\.[^./]*\\z')) WHEN '.pdf' THEN 'application/pdf' WHEN '.epub' THEN 'application/epub+zip' WHEN '.txt' THEN 'text/plain' END AS mime FROM {X.FILES}")
def file_info(spark, sf_dir):
    from leafmill.sources.files import file_info as info

    return info(_files(spark, sf_dir))


@query(f"SELECT path, left(body, 1024) AS head FROM {X.FILES}")
def binary_header(spark, sf_dir):
    from leafmill.sources.files import headers

    return headers(_files(spark, sf_dir)).select("path", N.latin(F.col("content")).alias("head"))


@query(f"SELECT config_key, differs FROM (SELECT books.config_key, concat_ws(',', CASE WHEN books.file_type IS DISTINCT FROM manifests.file_type THEN 'file_type' END, CASE WHEN books.size IS DISTINCT FROM manifests.size THEN 'size' END, CASE WHEN books.page_count IS DISTINCT FROM manifests.page_count THEN 'page_count' END) AS differs FROM {X.DUCK['BOOKS']} JOIN {X.DUCK['MANIFESTS']} USING (config_key)) WHERE differs <> ''")
def manifest_drift(spark, sf_dir):
    from leafmill.sources.manifests import drift

    return drift(X.fixture(spark, sf_dir, "BOOKS"), X.fixture(spark, sf_dir, "MANIFESTS")).select("config_key", F.concat_ws(",", "differs").alias("differs"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('cached ', doc_id) ELSE text END AS text FROM documents")
def cached_result(spark, sf_dir):
    from leafmill.sources.files import with_cache

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where(F.col("doc_id") % 3 == 0).select("doc_id", F.concat(F.lit("cached "), F.col("doc_id").cast("string")).alias("text"))
    return with_cache(docs, old, "doc_id", "text")


@query(f"SELECT format, lower(format) IN ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'bmp') AS needed FROM {X.DUCK['FORMATS']}")
def ocr_required(spark, sf_dir):
    from leafmill.functions.structure import needs_recognition

    return X.fixture(spark, sf_dir, "FORMATS").select("format", needs_recognition(F.col("format")).alias("needed"))


@query(f"SELECT config_key, 'txt' AS source, text FROM {X.DUCK['EXTRACTED']} UNION ALL SELECT config_key, 'ocr', CASE WHEN trim(coalesce(ocr_text, '')) <> '' THEN ocr_text ELSE concat('# OCR Processing Failed', chr(10), chr(10), 'No OCR results available.') END FROM {X.DUCK['EXTRACTED']} WHERE trim(coalesce(ocr_text, '')) <> '' OR file_type = 'pdf-text-ocr'")
def raw_outputs(spark, sf_dir):
    from leafmill.sources.sinks import raw_rows

    return raw_rows(X.fixture(spark, sf_dir, "EXTRACTED"))


@query("SELECT conv_id AS book_id, turn AS page_no, text FROM conversations")
def page_json(spark, sf_dir):
    """Written as JSON and read back."""
    from leafmill.sources.sinks import page_json as dump

    pages = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_no"), F.array(F.struct("text")).alias("paragraphs"))
    return dump(pages).select("book_id", "page_no", F.get(F.from_json("json", "array<struct<text:string>>"), 0)["text"].alias("text"))


from leafmill.plans import book_queries as _more  # noqa: E402, F401  registers its own
