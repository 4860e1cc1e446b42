"""Quality rules: a learned decision list, applied as ordered Spark conditions.

Statistics and verdicts are DataFrame expressions throughout. Learning is sequential covering on a
bounded sample of labelled rows: rules are grown one threshold at a time by information gain,
pruned on rows set aside, and kept while they are precise there; each takes the rows that it
covers out of what the next one sees. The list comes out as CASE WHEN conditions in that order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
#: Labelled rows that a list is learned from, at most; taken by a hash of their id.
SAMPLE_ROWS = 6000
#: A rule stays if so much of what it covers, on rows it was not grown on, has label 0.
PRECISION = 0.97
MAX_RULES = 12
MAX_TERMS = 4
#: Thresholds tried for a statistic: quantiles of the rows that a rule still covers.
CUTS = 24

#: Statistics that rules may test, from counts.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "lines_per_word", "upper_share", "digit_share")


# -- statistics -----------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often and deep body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 words that are found twice or more, the first included.

    Equal windows have equal 64-bit hashes, so a text whose hashes are distinct has none. Of the others,
    the windows whose hash is met again are compared as strings: a collision doesn't count.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = lambda ids: F.transform(starts, lambda i: F.xxhash64(F.slice(ids, i, WINDOW)))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda ids: let(hashes(ids), lambda h: _covered(words, h)))
    return F.when(F.size(words) > WINDOW, found).otherwise(0).cast("long")


def _with_equal(pairs: Column, field: str) -> Column:
    """Of structs sorted by ``field``, those that have it in common with a neighbour."""
    def equal(p, x, j):
        return F.coalesce(F.get(p, j - 1)[field] == x[field], F.lit(False)) | F.coalesce(F.get(p, j + 1)[field] == x[field], F.lit(False))

    return let(F.sort_array(pairs), lambda p: F.filter(p, lambda x, j: equal(p, x, j)))


def _covered(words: Column, hashes: Column) -> Column:
    """Number of words under repeated windows, from the hash of the window at each start."""
    maybe = _with_equal(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), "h")
    texts = F.transform(maybe, lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, WINDOW), " ").alias("t"), x["i"].alias("i")))
    starts = F.sort_array(F.transform(_with_equal(texts, "t"), lambda x: x["i"]))
    # Each window adds the words after the end of the one before it.
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    fold = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(fold)


def add_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the learned list's other
    statistics to doc_id and text.

    docs: needs doc_id and text; other columns are dropped. Null text: no words, all counts 0.
    Repeated rows are counted row by row; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def counts(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
        )

    both = let(words, lambda w: let(lines, lambda ln: counts(w, ln)))
    return docs.select("doc_id", both.alias("counts")).select("doc_id", "counts.*")


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "lines_per_word": F.col("n_lines") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


# -- learning -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.cut if self.above else f <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Term, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def _counts(rule: Rule, rows: list[dict]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if covers(rule, r)]
    return sum(hit), len(hit) - sum(hit)


def _cuts(values: list[float]) -> list[float]:
    """Midpoints between distinct values, thinned to quantiles."""
    v = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
    return mids if len(mids) <= CUTS else [mids[(len(mids) - 1) * k // (CUTS - 1)] for k in range(CUTS)]


def grow(rows: list[dict]) -> Rule:
    """Add the term of the highest information gain until no good row is covered."""
    rule: Rule = ()
    while len(rule) < MAX_TERMS:
        bad, good = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not bad or not good:
            break
        before, best, top = math.log2(bad / (bad + good)), None, 0.0
        for f in FEATURES:
            for cut in _cuts([r[f] for r in rows]):
                p, n = sum(r["bad"] and r[f] > cut for r in rows), sum(not r["bad"] and r[f] > cut for r in rows)
                for above, p1, n1 in ((True, p, n), (False, bad - p, good - n)):
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - before) if p1 else 0.0
                    if gain > top + 1e-9:
                        best, top = Term(f, above, cut), gain
        if not best:
            break
        rule, rows = (*rule, best), [r for r in rows if best.holds(r)]
    return rule


def prune(rule: Rule, rows: list[dict]) -> Rule:
    """The leading terms that are worth most on rows that the rule wasn't grown on."""
    def worth(r: Rule) -> float:
        p, n = _counts(r, rows)
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=rule)


def learn(rows: list[dict]) -> list[Rule]:
    """Ordered rules for ``bad``; rows: the features, ``bad``, and ``part`` (0 and 1: for growing, 2: for pruning, 3: for the test of
    precision, which no rule has seen)."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        fit, held, test = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2], [r for r in rows if r["part"] == 3]
        if sum(r["bad"] for r in fit) < 5:
            break
        rule = prune(grow(fit), held)
        p, n = _counts(rule, test)
        if not rule or p < 2 or p / (p + n) < PRECISION:
            break
        rules.append(rule)
        rows = [r for r in rows if not covers(rule, r)]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled documents (labels: doc_id, quality 0 or 1; others
    are ignored). Without labels of both kinds the list is empty."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    total = known.count()
    if not total:
        return []
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(1_000_000))
    # Somewhat more than the bound by share, then the least draws up to it: which rows follows from their ids alone.
    some = known.where(draw < max(1, int(1_000_000 * min(1.0, (1.2 * sample_rows + 100) / total))))
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # 0 wins where labels disagree
    some = some.orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), "doc_id").limit(sample_rows)
    rows = add_statistics(docs.join(F.broadcast(some), "doc_id", "left_semi")).join(F.broadcast(some), "doc_id")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(4))
    # Of rows that have one id (their labels can't be told apart), that with the fewest words, and so on by its statistics.
    told = F.struct("n_words", *(c.alias(k) for k, c in features().items() if k != "n_words"))
    got = rows.groupBy("doc_id").agg(F.min(F.struct((F.col("quality") == 0).alias("bad"), part.alias("part"), told.alias("f"))).alias("r")).select("doc_id", "r.bad", "r.part", "r.f.*").collect()
    return learn(sorted((r.asDict() for r in got), key=lambda r: r["doc_id"]))


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, else null: one CASE WHEN in the list's order."""
    out = None
    for i, rule in enumerate(rules):
        both = rule[0].column()
        for t in rule[1:]:
            both = both & t.column()
        out = F.when(both, i) if out is None else out.when(both, i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics and verdict of every document: rule is the number of the rule that rejects it.
    Null and empty texts have base_failed true; other rows are judged by whole text."""
    stats = add_statistics(docs)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
