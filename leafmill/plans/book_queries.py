"""Queries of books: configuration by rows, layout, validation, manifests, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.lines import CleanOptions
from leafmill.operators.clean import clean_text
from leafmill.operators.repeats import dice_similarity
from leafmill.plans import fixtures as X
from leafmill.plans import oracles as O
from leafmill.plans.queries import CUSTOM, OPTIONS, _docs, _files, _lines, ocr_pages, query
from leafmill.sources import store

# -- similar lines ----------------------------------------------------------------------------

_PAIRS = "list_transform(range(1, length({0})), lambda i: substring({0}, i, 2))"


@query(f"""{O.LINES}, p AS (SELECT doc_id, pos, line, prev, {_PAIRS.format('line')} AS a, {_PAIRS.format('prev')} AS b FROM raw WHERE pos > 0),
s AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS shared FROM p)
SELECT doc_id, pos, CASE WHEN line = '' OR prev = '' THEN (line = prev)::INT::DOUBLE WHEN abs(length(line) - length(prev)) / greatest(length(line), length(prev)) > 0.25 OR length(line) + length(prev) = 2 THEN 0
ELSE 2 * coalesce(shared, 0) / (length(line) + length(prev) - 2)::DOUBLE END AS similarity FROM s""")
def line_similarity(spark, sf_dir):
    """Dice similarity of each line and the one before it."""
    lines = _lines(spark, sf_dir).where("pos > 0")
    return lines.select("doc_id", "pos", dice_similarity(F.col("line"), F.col("prev")).alias("similarity"))


# -- configuration ----------------------------------------------------------------------------


@query(f"""SELECT * FROM ({O.cleaned()} SELECT doc_id, cleaned_text FROM doc) WHERE doc_id % 3 = 0
UNION ALL SELECT * FROM ({O.cleaned(ocr=True)} SELECT doc_id, cleaned_text FROM doc) WHERE doc_id % 3 = 1
UNION ALL SELECT * FROM ({O.cleaned(without=('toc_leader', 'url'))} SELECT doc_id, cleaned_text FROM doc) WHERE doc_id % 3 = 2""")
def book_config(spark, sf_dir):
    """Documents of three kinds of books, one of them with a setting of the book's own, cleaned by one plan."""
    from leafmill.plans.config import clean_configured, configured

    docs = _docs(spark, sf_dir).withColumn("kind", F.when(F.col("doc_id") % 3 == 1, "scanned").when(F.col("doc_id") % 3 == 2, "plain")).withColumn("book", F.col("doc_id") % 3)
    kinds = spark.createDataFrame([("scanned", "ocr", None), ("plain", "pdf", False)], "kind string, source string, remove_toc boolean")
    books = spark.createDataFrame([(2, False)], "book long, remove_urls boolean")
    return clean_configured(configured(docs, (kinds, "kind"), (books, "book"), defaults=CleanOptions(extra_patterns=CUSTOM))).select("doc_id", "cleaned_text")


# -- layout -----------------------------------------------------------------------------------

_E = "STRUCT(n BIGINT, s DOUBLE, lo DOUBLE, hi DOUBLE, ws DOUBLE, wm DOUBLE)"


@query(f"""WITH RECURSIVE pg AS (SELECT page_no, list_sort(list(x0)) AS xs, list(x1 - x0 ORDER BY n) AS ws FROM {X.lines_sql('duckdb')} GROUP BY page_no),
r AS (SELECT page_no, 0 AS k, CAST([] AS {_E}[]) AS g FROM pg
UNION ALL SELECT page_no, k + 1, CASE WHEN coalesce(fst, 0) = 0 THEN list_append(g, {{'n': 1::BIGINT, 's': x, 'lo': x, 'hi': x, 'ws': w, 'wm': w}})
  ELSE list_transform(g, lambda e, i: CASE WHEN i = fst THEN {{'n': e.n + 1, 's': e.s + x, 'lo': e.lo, 'hi': x, 'ws': e.ws + w, 'wm': greatest(e.wm, w)}} ELSE e END) END
  FROM (SELECT r.page_no, k, g, xs[k + 1] AS x, ws[k + 1] AS w, list_position(list_transform(g, lambda e: abs(xs[k + 1] - e.s / e.n) <= 7), true) AS fst FROM r JOIN pg USING (page_no) WHERE k < len(xs))),
u AS (SELECT page_no, unnest(g) AS e FROM r JOIN pg USING (page_no) WHERE k = len(xs))
SELECT page_no, row_number() OVER (PARTITION BY page_no ORDER BY e.s / e.n)::INT AS place, e.n AS lines, e.s / e.n AS mean, e.lo AS min_x0, e.hi AS max_x0, e.ws / e.n AS average_width, e.wm AS max_width FROM u""")
def edge_groups(spark, sf_dir):
    """Groups of left edges of each page, by a fold in the order of the edges."""
    from leafmill.functions.layout import edge_groups as groups

    found = ocr_pages(spark, sf_dir).select("page_no", F.posexplode(groups(F.col("lines"))).alias("i", "g"))
    return found.select("page_no", (F.col("i") + 1).alias("place"), F.col("g.n").alias("lines"), (F.col("g.sum") / F.col("g.n")).alias("mean"), "g.min_x0", "g.max_x0", (F.col("g.width_sum") / F.col("g.n")).alias("average_width"), "g.max_width")


# -- validation -------------------------------------------------------------------------------


def page_extractor():
    """Stands for a PDF library: pages are what follows form feeds."""

    def extract(content: bytes, limit: int | None = None) -> tuple[int, str]:
        pages = content.decode("latin-1").split("\f")[1:]
        return len(pages), "".join(pages[:limit])

    return extract


def _detected() -> str:
    from leafmill.functions import files as N

    matches = " + ".join(f"len(regexp_extract_all(body, '{p}'))" for p in N.IMAGE_PATTERNS)
    return f"""WITH p AS (SELECT path, body, length, string_split(body, chr(12))[2:] AS pages, {matches} AS m FROM {X.FILES} WHERE left(body, 4) = '%PDF'),
q AS (SELECT *, len(pages) AS n, array_to_string(pages[:5], '') AS t, greatest(m // 3, (m > 0)::INT) AS images FROM p),
c AS (SELECT *, trim(t, chr(9) || chr(10) || chr(13) || ' ') = '' OR length(t) < 100 AS bare FROM q),
k AS (SELECT *, CASE WHEN n = 0 OR bare THEN 0 ELSE least(100, length(t) / least(n, 5) / 200 * 100) END AS coverage FROM c)
SELECT path, n::INT AS page_count, CASE WHEN n = 0 THEN 'empty' WHEN bare THEN CASE WHEN m > 0 THEN 'image_based' ELSE 'empty' END WHEN m > 0 THEN CASE WHEN coverage > 60 THEN 'hybrid' ELSE 'image_based' END ELSE 'text_based' END AS content_type,
  coverage::DOUBLE AS coverage, images::BIGINT AS image_count, array_to_string(range(1, least(n, images) + 1), ',') AS image_pages, n > 0 AND length <= 26214400 AS is_valid,
  concat_ws('; ', CASE WHEN length > 26214400 THEN 'size' END, CASE WHEN n = 0 THEN 'PDF has no pages' WHEN bare AND m > 0 THEN 'PDF contains images without embedded text (requires OCR processing)' WHEN bare THEN 'PDF has no embedded text and no detected images'
    WHEN m > 0 AND coverage > 60 THEN concat('PDF has mixed content (text and ', images, ' images)') WHEN m > 0 THEN concat('PDF is primarily image-based (', images, ' images, low text coverage)') WHEN coverage < 50 THEN 'PDF has moderate text content' END) AS issues FROM k"""


@query(_detected())
def pdf_validation(spark, sf_dir):
    """What detection says about PDFs by their first pages."""
    from leafmill.plans.pipeline import detect

    found = detect(_files(spark, sf_dir), page_extractor()).where(F.col("body").startswith("%PDF"))
    return found.select("path", "page_count", "content_type", "coverage", "image_count", F.array_join(F.transform("image_pages", lambda x: x.cast("string")), ",").alias("image_pages"), "is_valid", F.concat_ws("; ", "issues").alias("issues"))


# -- metrics and manifests --------------------------------------------------------------------

_SUMS = ["original_lines", "final_lines", "sections_stripped", "repeated_lines", *O.REASONS]


@query(f"SELECT count(*) AS documents, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _SUMS)} FROM ({O.stats()})")
def clean_metrics(spark, sf_dir):
    """Sums that the cleaning pass itself reports: no second one."""
    from leafmill.plans.pipeline import observed

    out, found = observed(clean_text(_docs(spark, sf_dir), OPTIONS))
    out.select("doc_id", "cleaned_text").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(found.get[c] for c in ("documents", *_SUMS))], ", ".join(f"{c} long" for c in ("documents", *_SUMS)))


@query("""SELECT concat('b', doc_id, '#t') AS config_key, 'b' || doc_id AS author, '# Title|' || array_to_string(string_split_regex(trim(replace(coalesce(text, ''), chr(10), ' '), ' '), '\\s+')[:5], ' ') AS structure,
concat('first note|second ', doc_id) AS footnotes, length(coalesce(text, '')) AS size FROM documents WHERE trim(replace(coalesce(text, ''), chr(10), ' '), chr(9) || chr(13) || ' ') <> ''""")
def manifest_update(spark, sf_dir):
    """Outlines and notes of books merged into manifest files, which are read back."""
    from leafmill.sources import manifests as M

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    text = F.concat(F.lit("# Title\n\n"), line, F.lit("\n\n# FUSSNOTEN\n\n[M] first note\n[T]second "), F.col("doc_id").cast("string"))
    books = docs.where(F.btrim(line, F.lit("\t\r ")) != "").select(F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit("#t")).alias("config_key"), text.alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    folder = store.shared(spark, "manifests")
    M.update_all(spark, folder, books.select("config_key", "size")).write.format("noop").mode("overwrite").save()
    M.update_all(spark, folder, M.from_books(books)).write.format("noop").mode("overwrite").save()
    return M.table(spark, folder).select("config_key", "author", F.array_join("structure", "|").alias("structure"), F.array_join("footnotes", "|").alias("footnotes"), "size")
