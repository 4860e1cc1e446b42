"""Cleaning of whole documents in one narrow projection: nothing is shuffled.

A document's lines stay together as an array, on which sections, repeats and removals are decided; hyphen breaks, paragraphs
and blank lines are then mended in the joined text by three regular expressions, in time linear in its length. Splits of the
input are all the parallelism there is to plan, a lost task reads its split again, and the same plan runs on a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import patterns as P
from leafmill.functions.lines import COUNTERS, CleanOptions, RowOptions, drop_reason, either, is_plain, long_enough, marks_of, may_repeat, repeat_threshold
from leafmill.functions.text import BEYOND_LATIN, UNUSUAL, is_spaced, let, normalize_unicode, rejoin_spaced, trim
from leafmill.operators.repeats import fuzzy_flags

ENDS_WITHIN, BLANKS_WITHIN, TRAILING_LINES = 50, 30, 10


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def normal_lines(text: Column) -> Column:
    """Lines of the normalised text. Only lines with a character that changes are rewritten."""
    unusual = lambda x: F.regexp_like(x, F.lit(BEYOND_LATIN)) & F.regexp_like(x, F.lit(UNUSUAL))
    return F.transform(split_lines(F.replace(text, F.lit("\f"), F.lit("\n"))), lambda x: F.when(unusual(x), normalize_unicode(x)).otherwise(x))


# -- sections -------------------------------------------------------------------------------


def _views(lines: Column) -> Column:
    """Each line with its trimmed form and in lower case: both are asked for many times."""
    return F.transform(lines, lambda x: F.struct(x.alias("line"), trim(x).alias("t"), F.lower(x).alias("low")))


def _has(view: Column, patterns: list[str]) -> Column:
    """Whether a line matches one of some patterns of ANYWHERE: what they need is looked for in the lower case first."""
    some = reduce(lambda a, b: a | b, (F.contains(view["low"], F.lit(P.ANYWHERE[p])) for p in patterns))
    return some & F.regexp_like(view["line"], F.lit(P.any_of(patterns)))


def _first(flags: Column, low: Column, count: Column | int) -> Column:
    """First position from ``low`` on, within ``count`` lines, whose flag holds; null if there is none."""
    found = F.array_position(F.slice(flags, low + 1, F.lit(count) if isinstance(count, int) else count), F.lit(True))
    return F.when(found > 0, low + found.cast("int") - 1)


def sections(lines: Column) -> Column:
    """Inserted profile pages as (first, end) positions: from a signature to the end marker and what follows it, else
    to two blank lines, else 30 lines on. A signature within a section starts none. A section looks at the lines that it may hold, not
    at all of the document."""
    return let(_views(lines), _sections)


def _sections(views: Column) -> Column:
    blank = lambda i: F.coalesce(F.get(views, i)["t"] == "", F.lit(False))
    # What begins anywhere is looked for where the words that it needs are.
    begin = F.lit(P.any_of([p for p in P.SECTION_MORE if p not in P.ANYWHERE]))
    parts = F.struct(
        F.filter(F.transform(views, lambda x, i: F.when(_has(x, [P.SIGNATURE]), i)), lambda i: i.isNotNull()).alias("starts"),
        F.transform(views, lambda x: _has(x, P.SECTION_END)).alias("ends"),
        F.transform(views, lambda x: ~((x["t"] == "") | F.regexp_like(x["line"], begin) | _has(x, [p for p in P.SECTION_MORE if p in P.ANYWHERE]))).alias("others"),
        F.transform(views, lambda x, i: (x["t"] == "") & blank(i + 1)).alias("gaps"),
        F.size(views).alias("n"),
    )

    def end_of(p: Column, i: Column) -> Column:
        def end(mark: Column) -> Column:
            after = F.coalesce(_first(p["others"], mark + 1, p["n"]), p["n"])
            gap = F.coalesce(_first(p["gaps"], i, BLANKS_WITHIN), F.least(i + BLANKS_WITHIN, p["n"]))
            return F.when(mark.isNotNull(), after).otherwise(gap)

        return let(_first(p["ends"], i, ENDS_WITHIN), end)

    def fold(p: Column) -> Column:
        none = F.array().cast("array<struct<first:int,end:int>>")

        def step(acc: Column, i: Column) -> Column:
            free = F.coalesce(i >= F.get(acc, F.size(acc) - 1)["end"], F.lit(True))
            return F.when(free, F.concat(acc, F.array(F.struct(i.alias("first"), end_of(p, i).cast("int").alias("end"))))).otherwise(acc)

        return F.aggregate(p["starts"], none, step)

    return let(parts, fold)


def _strip_sections(views: Column, found: Column) -> Column:
    """Lines outside ``found`` (ascending, apart from each other), without a link to statistics among the last ten."""
    n = F.size(views)
    trailing = lambda x, i: (i >= n - TRAILING_LINES) & F.contains(x["low"], F.lit("publication")) & F.regexp_like(x["line"], F.lit(P.TRAILING))
    left = F.transform(views, lambda x, i: F.when(~trailing(x, i), x))
    begins = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["end"]))
    ends = F.concat(F.transform(found, lambda s: s["first"]), F.array(n))
    between = lambda whole: F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(whole, a + 1, F.greatest(b - a, F.lit(0)))))
    return F.filter(let(left, between), lambda x: x.isNotNull())


# -- repeats --------------------------------------------------------------------------------


def repeated_lines(trimmed: Column, threshold: Column) -> Column:
    """Trimmed lines that are there ``threshold`` times or more and may count as headers; each once. Whether a line may is asked of those that are there so often."""
    long = F.sort_array(F.filter(trimmed, long_enough))
    often = let(long, lambda w: F.array_distinct(F.filter(w, lambda x, i: F.coalesce(F.get(w, i + threshold - 1) == x, F.lit(False)))))
    return F.filter(often, may_repeat)


# -- mending --------------------------------------------------------------------------------


def rejoin_hyphens(text: Column) -> Column:
    """A word broken by a hyphen at a line end, and the next line if it goes on in lower case. What is joined
    is passed over, so its own end joins nothing."""
    return F.regexp_replace(text, r"-(?<=[A-Za-z0-9_]-)[ \t\r]*\n[ \t\r]*([a-z\x{E0}-\x{24F}][^\n]*)", "$1")


def rewrap(text: Column, aggressive: bool = False, trimmed: bool = False) -> Column:
    """Lines trimmed (unless they are); a line goes on with the next if its end is no sentence's and the next begins in lower case, or
    after a comma; if aggressive, whenever the next begins in lower case."""
    lines = text if trimmed else F.regexp_replace(text, r"(?<=\n|^)[ \t\r]+|[ \t\r]+(?=\n|\z)", "")
    ends = "".join("\\" + c if c in "]}\"'" else c for c in P.SENTENCE_ENDS)
    # The line end comes first, so that nothing is tried at other characters.
    join = rf"(?<=,\n)(?=[^\n])|(?<=[^\n{ends}]\n)(?={P.LOWER})"
    if aggressive:
        join += rf"|(?<=[^\n]\n)(?={P.NOT_UPPER})"
    return F.regexp_replace(lines, rf"\n(?:{join})", " ")


def collapse_blanks(text: Column) -> Column:
    """Two blank lines in a row at most, none at the ends. Lines are trimmed already."""
    return F.btrim(F.regexp_replace(text, r"\n{4,}", "\n\n\n"), F.lit("\n"))


# -- documents ------------------------------------------------------------------------------


NO_SECTIONS = "array<struct<first:int,end:int>>"


def _analysed(text: Column, o: CleanOptions | RowOptions) -> Column:
    """lines (after normalisation and sections), sections (their number) and threshold of a document."""

    def build(views: Column) -> Column:
        has = F.exists(views, lambda x: _has(x, [P.SIGNATURE]))
        found = F.when(has, _sections(views)).otherwise(F.array().cast(NO_SECTIONS))
        return let(found, lambda s: let(_strip_sections(views, s), lambda left: result(left, F.size(s))))

    def result(left: Column, n: Column) -> Column:
        # A document whose every line is in a section still has one, empty, line.
        empty = F.array(F.struct(*(F.lit("").alias(k) for k in ("line", "t", "low"))))
        threshold = repeat_threshold(F.greatest(F.size(left), F.lit(1)), o.aggressive)
        return let(F.when(F.size(left) == 0, empty).otherwise(left), lambda x: F.struct(x["line"].alias("lines"), x["t"].alias("trimmed"), x["low"].alias("low"), n.alias("sections"), threshold.alias("threshold")))

    return let(_views(normal_lines(text)), build)


def _reasons(x: Column, repeated: Column, o: CleanOptions | RowOptions) -> Column:
    lines, trimmed = x["lines"], x["trimmed"]
    blank = lambda i: F.coalesce(F.get(trimmed, i), F.lit(""))

    def reason(line: Column, i: Column, marks: Column) -> Column:
        t = F.get(trimmed, i)
        return drop_reason(line, blank(i - 1), blank(i + 1), is_plain(t, F.get(x["low"], i), marks), F.array_contains(repeated, t), F.get(x["fuzzy"], i), o)

    return let(let(F.array_join(x["low"], "\n"), marks_of), lambda marks: F.transform(lines, lambda line, i: reason(line, i, marks)))


def _fuzzy(lines: Column, threshold: Column, aggressive: bool | Column) -> Column:
    """Flags of lines; of rows that aren't aggressive no line goes to Python."""
    none = F.array().cast("array<boolean>")
    if isinstance(aggressive, Column):
        return fuzzy_flags(F.when(aggressive, lines).otherwise(F.array().cast("array<string>")), threshold)
    return fuzzy_flags(lines, threshold) if aggressive else none


def line_table(docs: DataFrame, options: CleanOptions | RowOptions = CleanOptions(), text: str = "text", finish=None) -> DataFrame:
    """docs with a struct column ``_doc``: lines, trimmed, sections, threshold, fuzzy, repeated, reasons (why each line goes, null if it
    stays). Null text counts as empty. finish: makes another struct of it, in the same projection."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_doc", _analysed(whole, options))
    fuzzy = _fuzzy(F.col("_doc.lines"), F.col("_doc.threshold"), options.aggressive)
    names = ("lines", "trimmed", "sections", "threshold")

    def judge(x: Column) -> Column:
        return let(repeated_lines(x["trimmed"], x["threshold"]), lambda r: let(_reasons(x, r, options), lambda why: F.struct(*(x[k].alias(k) for k in names), x["fuzzy"].alias("fuzzy"), r.alias("repeated"), why.alias("reasons"))))

    # Each step's value is bound once: the optimiser may merge projections, but not repeat them within a line.
    x = F.struct(*(F.col(f"_doc.{k}").alias(k) for k in (*names, "low")), fuzzy.alias("fuzzy"))
    return out.withColumn("_doc", let(x, lambda y: let(judge(y), finish) if finish else judge(y)))


def clean_text(docs: DataFrame, options: CleanOptions | RowOptions = CleanOptions(), text: str = "text") -> DataFrame:
    """Add cleaned_text and stats to docs. A document that loses every line keeps its row, with an empty text. Options are the same for
    all rows, or columns of docs."""
    counters = {c: [r for r, k in COUNTERS.items() if k == c] for c in dict.fromkeys(COUNTERS.values())}

    def finish(x: Column) -> Column:
        # Blanks at line ends don't matter from here on.
        kept = F.filter(x["trimmed"], lambda line, i: F.get(x["reasons"], i).isNull())
        whole = F.array_join(either(options.ocr, F.transform(kept, lambda line: F.when(is_spaced(line), rejoin_spaced(line)).otherwise(line)), kept), "\n")
        joined = let(rejoin_hyphens(whole), lambda t: either(options.aggressive, rewrap(t, True, trimmed=True), rewrap(t, False, trimmed=True)))
        return let(collapse_blanks(joined), lambda t: F.struct(t.alias("text"), stats(x, t).alias("stats")))

    def stats(x: Column, cleaned: Column) -> Column:
        count = lambda names: F.size(F.filter(x["reasons"], lambda r: r.isin(names))).cast("long")
        final = F.when(cleaned == "", 0).otherwise(1 + F.length(cleaned) - F.length(F.translate(cleaned, "\n", "")))
        return F.struct(
            (options.source if isinstance(options.source, Column) else F.lit(options.source)).alias("source"),
            F.size(x["lines"]).cast("long").alias("original_lines"),
            final.cast("long").alias("final_lines"),
            x["sections"].cast("long").alias("sections_stripped"),
            F.size(x["repeated"]).cast("long").alias("repeated_lines"),
            x["threshold"].cast("long").alias("repeat_threshold"),
            F.size(F.filter(x["fuzzy"], lambda f: f)).cast("long").alias("fuzzy_lines"),
            F.struct(*(count(v).alias(k) for k, v in counters.items())).alias("removed"),
        )

    out = line_table(docs, options, text, finish)
    return out.select(*docs.columns, F.col("_doc.text").alias("cleaned_text"), F.col("_doc.stats").alias("stats"))
