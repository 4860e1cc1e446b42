"""Column functions over files: formats, names, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import let

# -- fixed values ---------------------------------------------------------------------------

LIMITS = {"pdf": 25 * 1024 * 1024, "epub": 5 * 1024 * 1024, "txt": 1024 * 1024}
MIME = {"pdf": "application/pdf", "epub": "application/epub+zip", "txt": "text/plain"}
IMAGE_PATTERNS = [
    r"(?i)/XObject\s*<<[^>]*/Subtype\s*/Image",
    r"(?i)/Type\s*/XObject[^>]*/Subtype\s*/Image",
    r"(?i)/Filter\s*/DCTDecode",
    r"(?i)/Filter\s*/FlateDecode[^>]*/BitsPerComponent",
    r"(?i)/Filter\s*/CCITTFaxDecode",
    r"(?i)/Filter\s*/JBIG2Decode",
    r"(?i)/Filter\s*/JPXDecode",
    r"(?i)stream\s*\r?\n[^\n\r]*?JFIF",
    r"(?i)stream\s*\r?\n[^\n\r]*?PNG",
    r"(?i)/Im\d+\s+\d+\s+\d+\s+R",
    r"(?i)/I\d+\s+\d+\s+\d+\s+R",
    r"(?i)/Image\d+\s+\d+\s+\d+\s+R",
]
TITLE_CHARS, AUTHOR_CHARS, NAME_CHARS = 200, 100, 255
DEFAULT_NAME = "{author}#{title}[#{bookIndex}]-{timestamp}"

# -- formats --------------------------------------------------------------------------------


def latin(content: Column) -> Column:
    """Bytes as characters, one each."""
    return F.decode(content, "ISO-8859-1")


def is_likely_text(content: Column) -> Column:
    """More than 0.7 of the first 512 bytes are printable; an empty file isn't text."""
    head = latin(F.substring(content, 1, 512))
    printable = F.length(F.regexp_replace(head, r"[^\x20-\x7E\t\n\r\x80-\xFF]", ""))
    return (F.length(head) > 0) & (10 * printable > 7 * F.length(head))


def magic_format(content: Column) -> Column:
    """Format by the first bytes, else whether it is likely text, else null."""
    four = F.hex(F.substring(content, 1, 4))
    return F.when(four == "25504446", "pdf").when(four == "504B0304", "epub").when(four.startswith("EFBBBF"), "txt").when(is_likely_text(content), "txt")


def magic_confidence(content: Column) -> Column:
    four = F.hex(F.substring(content, 1, 4))
    return F.when(four == "25504446", 0.95).when((four == "504B0304") | four.startswith("EFBBBF"), 0.8).when(is_likely_text(content), 0.6).otherwise(0.0)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower case, with its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^[^/]+(\.[^./]*)\z", 1))


def extension_format(path: Column) -> Column:
    e = extension(path)
    return F.when(e == ".pdf", "pdf").when(e == ".epub", "epub").otherwise("txt")


def exceeds_limit(fmt: Column, length: Column) -> Column:
    return length > F.when(fmt == "pdf", LIMITS["pdf"]).when(fmt == "epub", LIMITS["epub"]).otherwise(LIMITS["txt"])


def mime_type(fmt: Column) -> Column:
    return F.when(fmt == "pdf", MIME["pdf"]).when(fmt == "epub", MIME["epub"]).otherwise(MIME["txt"])


def format_confidence(magic: Column, by_name: Column, confidence: Column, valid: Column) -> Column:
    """Less where magic number and extension disagree, half where anything is invalid."""
    c = confidence * F.when(magic != by_name, 0.8).otherwise(1.0) * F.when(valid, 1.0).otherwise(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def pdf_version(content: Column) -> Column:
    v = F.regexp_extract(latin(F.substring(content, 1, 8)), r"%PDF-(\d+\.\d+)", 1)
    return F.when(v != "", v).otherwise("unknown")


def text_coverage(pages: Column, text: Column) -> Column:
    return F.least(F.lit(100.0), F.length(text) / F.least(pages, F.lit(5)) / 200 * 100)


def pdf_content_type(pages: Column, text: Column, images: Column) -> Column:
    bare = (F.btrim(text, F.lit(" \t\r\n")) == "") | (F.length(text) < 100)
    scanned = F.when(images, "image_based").otherwise("empty")
    mixed = F.when(text_coverage(pages, text) > 60, "hybrid").otherwise("image_based")
    return F.when(pages == 0, "empty").when(bare, scanned).when(images, mixed).otherwise("text_based")


def pdf_parts(pages: Column, text: Column, matches: Column) -> Column:
    """What the validation of a PDF finds: content_type, coverage (of 200 characters a page, in hundredths), image_count, image_pages, issues.

    pages: of the whole file; text: of its first five; matches: of image patterns. The first pages, as many as there are images by
    estimate, count as image pages. A file without pages is the only one that isn't valid."""
    images, count = matches > 0, image_estimate(matches)
    kind = pdf_content_type(pages, text, images)
    bare = (F.btrim(text, F.lit(" \t\r\n")) == "") | (F.length(text) < 100)
    coverage = F.when((pages == 0) | bare, F.lit(0.0)).otherwise(text_coverage(pages, text))
    number = count.cast("string")
    issue = (
        F.when(pages == 0, "PDF has no pages").when(bare & images, "PDF contains images without embedded text (requires OCR processing)")
        .when(bare, "PDF has no embedded text and no detected images").when(kind == "hybrid", F.concat(F.lit("PDF has mixed content (text and "), number, F.lit(" images)")))
        .when(kind == "image_based", F.concat(F.lit("PDF is primarily image-based ("), number, F.lit(" images, low text coverage)")))
        .when(coverage < 50, "PDF has moderate text content")
    )
    shown = F.least(pages.cast("long"), count)
    of_pages = F.when(images & (shown > 0), F.sequence(F.lit(1), F.greatest(shown, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.struct(kind.alias("content_type"), coverage.alias("coverage"), count.alias("image_count"), of_pages.alias("image_pages"), F.filter(F.array(issue), lambda x: x.isNotNull()).alias("issues"))


def image_matches(content: Column) -> Column:
    out = F.lit(0)
    for p in IMAGE_PATTERNS:
        out = out + F.regexp_count(latin(content), F.lit(p))
    return out.cast("long")


def image_estimate(matches: Column) -> Column:
    return F.greatest(F.floor(matches / 3), F.when(matches > 0, 1).otherwise(0)).cast("long")


def strategy(fmt: Column, content_type: Column) -> Column:
    """How text is to be had from a file."""
    pdf = F.when(content_type == "text_based", "pdf-text").when(content_type == "image_based", "pdf-ocr").otherwise("pdf-text-ocr")
    return F.when(fmt == "pdf", pdf).when(fmt == "epub", "epub").otherwise("text")


def manifest_file_type(path: Column, content_type: Column) -> Column:
    """As manifests name it: by extension, and a PDF with text counts as text."""
    pdf = F.when(content_type == "text_based", "text").when(content_type == "image_based", "pdf-ocr").otherwise("pdf-text-ocr")
    return F.when(extension(path) == ".pdf", pdf).when(extension(path) == ".epub", "epub").otherwise("text")


def format_issues(fmt: Column, magic: Column, by_name: Column, too_big: Column) -> Column:
    """What speaks against a file, as an array: its size, its validator (those of other formats than PDF always fail), and a
    name that says something else than its first bytes."""
    differ = F.concat(F.lit("Format mismatch: magic number suggests "), magic, F.lit(", extension suggests "), by_name)
    found = F.array(F.when(too_big, "size"), F.when(fmt != "pdf", "validation"), F.when(magic != by_name, differ))
    return F.filter(found, lambda x: x.isNotNull())


# -- names ----------------------------------------------------------------------------------


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^/])\.[^./]*\z", "")


def name_parts(path: Column) -> Column:
    """author, title, book_index, is_valid of author#title[#index]; other names are titles of Unknown."""
    s = stem(path)
    pattern = r"^([^#]+)#([^#]+)(?:#([^#]+))?\z"
    fits = F.regexp_like(s, F.lit(pattern))
    blank = lambda c: F.translate(c, "_", " ")
    author = blank(F.when(fits, F.regexp_extract(s, pattern, 1)).otherwise("Unknown"))
    title = F.substring(blank(F.when(fits, F.regexp_extract(s, pattern, 2)).otherwise(s)), 1, TITLE_CHARS)
    index = F.regexp_extract(s, pattern, 3)
    return F.struct(author.alias("author"), title.alias("title"), F.when(fits & (index != ""), blank(index)).alias("book_index"), (F.length(author) <= AUTHOR_CHARS).alias("is_valid"))


def config_key(parts: Column) -> Column:
    """Null where author or title is empty."""
    return F.when((parts["author"] != "") & (parts["title"] != ""), F.concat_ws("#", parts["author"], parts["title"], parts["book_index"]))


def _filler(key: str, value: Column):
    """Puts a value in place of the first of its placeholder."""
    return lambda o: F.when(F.instr(o, key) > 0, F.concat(F.substring_index(o, key, 1), value, F.substring(o, F.instr(o, key) + len(key), F.length(o)))).otherwise(o)


def output_name(parts: Column, timestamp: str, ending: str, pattern: str = DEFAULT_NAME) -> Column:
    """First of each placeholder filled, empty brackets dropped, ending added unless there."""
    out = F.lit(pattern)
    for key, value in (("{author}", parts["author"]), ("{title}", parts["title"]), ("{bookIndex}", F.coalesce(parts["book_index"], F.lit(""))), ("{timestamp}", F.lit(timestamp))):
        out = let(out, _filler(key, value))
    return let(F.regexp_replace(out, r"\[\s*\]", ""), lambda o: F.when(o.endswith(ending), o).otherwise(F.concat(o, F.lit(ending))))


def sanitize_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", "_"), 1, NAME_CHARS)


def is_plain_name(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[a-zA-Z0-9_\-#\s.]+\z"))


def duration(ms: Column) -> Column:
    """XmYs, or Ys under a minute."""
    s = F.floor(ms / 1000)
    m = F.floor(s / 60)
    return F.when(m > 0, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))
