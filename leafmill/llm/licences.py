"""Licence scans: Aho-Corasick automata for notice phrases and identifier tags, a shunting-yard
parser for the licence expressions behind the tags, and their evaluation.

Texts are reduced to words joined by single spaces, so a phrase is found wherever its words stand
consecutively, whatever stands between them. The words of the tags are among the phrases; where one is met, a
second automaton finds the tags in the lower-cased text itself, since their expressions need brackets and operators.

An expression is evaluated to what it asks of a user, from its licences' kinds: of alternatives (or) the least, of what holds
together (and) the most, and an exception (with) lowers a copyleft to a weak one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases of common licences (as words) and their labels; weight is their part of the score.
NOTICES = {
    "released under the mit license": ("mit", 0.9),
    "licensed under the mit license": ("mit", 0.9),
    "the mit license": ("mit", 0.6),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "licensed under the apache license": ("apache-2.0", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.6),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.8),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by nc": ("cc-by-nc", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc0 1 0 universal": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "this is free and unencumbered software": ("unlicense", 0.9),
}
#: Tags before a licence expression.
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
BASE_WEIGHT = {"cc-by": 0.5, "gpl": 0.7, "reserved": 0.6}
TAG_WEIGHT = 1.0

#: What licences ask for, from least to most.
KINDS_OF = ("public", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "restricted")
#: Identifiers of licences (families, their versions by rule below) by kind.
KNOWN = {
    "public": "cc0 unlicense 0bsd public-domain wtfpl pddl mit-0",
    "permissive": "mit mit-cmu x11 isc zlib bsl apache bsd bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsd-2-clause-patent bsd-3-clause-clear "
    "cc-by afl ecl ncsa python-2.0 psf postgresql ruby php openssl ssleay curl libpng ftl icu unicode-dfs unicode w3c zpl upl blueoak ofl artistic hpnd naist beerware ms-pl bzip2 vim tcl",
    "weak-copyleft": "lgpl mpl epl cpl cddl ms-rl apsl eupl osl erlpl ipl cecill-c ospl",
    "copyleft": "gpl gfdl cc-by-sa odbl cecill sleepycat rpl qpl",
    "network-copyleft": "agpl sspl",
    "restricted": "cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd busl elastic polyform json",
}
KIND = {name: kind for kind, names in KNOWN.items() for name in names.split()}
#: A version and what may follow it, behind a family's name.
_VERSION = re.compile(r"-v?\d+(?:\.\d+)*(?:-(?:only|or-later|universal|igo|[a-z]{2}|rfn|no-rfn|perl|cl8|invariants|no-invariants)){0,2}$")
#: Names that a project gives to licences of its own.
OWN_NAMES = ("licenseref-", "documentref-")

TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def kind_of(name: str) -> str | None:
    """What a licence asks for by its identifier, or None if that is none. Own names are the most restrictive."""
    name = name.removesuffix("+")
    if name.startswith(OWN_NAMES):
        return KINDS_OF[-1]
    return KIND.get(name) or KIND.get(_VERSION.sub("", name))


def parse_tokens(tokens: list[str]) -> list[str] | None:
    """The longest expression that ``tokens`` begin with, in reverse Polish order, or None.

    ``with`` binds tighter than ``and``, that tighter than ``or``; brackets group. One pass: wherever an operand or a
    bracket's end leaves no bracket open, what is read is an expression; the last such place counts."""
    whole, depth, operand_next = 0, 0, True
    for i, tok in enumerate(tokens):
        if tok in RANK or tok == ")":
            if operand_next or tok == ")" and not depth:
                break
            depth -= tok == ")"
            operand_next = tok != ")"
        elif not operand_next:
            break
        else:
            depth += tok == "("
            operand_next = tok == "("
        if not operand_next and not depth:
            whole = i + 1
    out, stack = [], []
    for tok in tokens[:whole]:
        if tok in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[tok]:
                out.append(stack.pop())
            stack.append(tok)
        elif tok == "(":
            stack.append(tok)
        elif tok == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            out.append(tok)
    return out + stack[::-1] or None


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in reverse Polish order, or None if the text isn't one from end to end.

    >>> parse_expression("mit or (apache-2.0 with llvm-exception and bsd)")
    ['mit', 'apache-2.0', 'llvm-exception', 'with', 'bsd', 'and', 'or']
    """
    tokens = TOKEN.findall(text)
    rpn = parse_tokens(tokens)
    return rpn if rpn and len(rpn) == sum(t not in "()" for t in tokens) and tokens.count("(") == tokens.count(")") else None


def evaluate(rpn: list[str]) -> str | None:
    """What an expression asks for (one of KINDS_OF), or None if no choice of its alternatives is known whole.

    ``or`` asks for the less of its sides, and a side that isn't known is no choice; ``and`` asks for the more, and is known only
    if both are; ``with`` an exception, a copyleft is a weak one."""
    stack: list[int | None] = []
    for i, tok in enumerate(rpn):
        if tok not in RANK:
            kind = kind_of(tok)
            stack.append(KINDS_OF.index(kind) if kind else None)
            continue
        b, a = stack.pop(), stack.pop()
        if tok == "with":
            stack.append(min(a, KINDS_OF.index("weak-copyleft")) if a is not None and a <= KINDS_OF.index("copyleft") else a)
        elif tok == "or":
            stack.append(a if b is None else b if a is None else min(a, b))
        else:
            stack.append(None if a is None or b is None else max(a, b))
    return None if stack[0] is None else KINDS_OF[stack[0]]


def licences_of(rpn: list[str]) -> list[str]:
    """The known licences that an expression names, exceptions left out."""
    return [t for i, t in enumerate(rpn) if t not in RANK and not (i + 1 < len(rpn) and rpn[i + 1] == "with") and kind_of(t)]


_EXPRESSION = re.compile(r"[ \t]*((?:[()]|[a-z0-9.+:-]+|[ \t])+)")


def tag_expression(low: str, end: int, upto: int | None = None) -> list[str] | None:
    """The longest expression on the line after a tag that ends at ``end``, up to where the next tag begins."""
    m = _EXPRESSION.match(low, end, len(low) if upto is None else upto)
    return parse_tokens([t.rstrip(".:") if len(t) > 1 else t for t in TOKEN.findall(m[1])]) if m else None


class Scanner:
    """One automaton over all phrases, each between spaces."""

    def __init__(self, extra: dict[str, tuple[str, float]] | None = None):
        import ahocorasick

        self.automaton, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        notices = NOTICES | (extra or {})
        tags = {" ".join(WORD.findall(t)) for t in TAGS}
        for phrase in BASE.keys() | notices.keys() | tags:
            label, weight = notices.get(phrase, (None, 0.0))
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, BASE.get(phrase), label, weight, phrase in tags))
        for t in TAGS:
            self.tags.add_word(t, len(t))
        self.automaton.make_automaton()
        self.tags.make_automaton()

    def _expressions(self, low: str) -> list[list[str]]:
        """Expressions behind tags. Of tags that end at one place, each says the same; an expression ends where another tag begins, so
        each character is read once for each tag that it is part of."""
        found = [(end + 1, end + 1 - size) for end, size in self.tags.iter(low)]
        ends, starts = sorted({e for e, _ in found}), sorted(s for _, s in found)
        upto = (starts[i] if (i := bisect_left(starts, e)) < len(starts) else None for e in ends)
        return [rpn for e, u in zip(ends, upto, strict=True) if (rpn := tag_expression(low, e, u))]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, asks."""
        low = (text or "").translate(UPPER)
        words = WORD.findall(low)
        joined = f" {' '.join(words)} "
        at, base, labels, miss, tagged = [], set(), set(), 1.0, False
        for end, (size, label, notice, weight, tag) in self.automaton.iter(joined):
            tagged |= tag
            if label:
                at.append(end - size + 1)
                base.add(label)
            if notice and notice not in labels:
                labels.add(notice)
                miss *= 1 - weight
        first = last = None
        if at:
            first, last = joined.count(" ", 0, min(at)), joined.count(" ", 0, max(at))
        expressions, asks = [], []
        for rpn in self._expressions(low) if tagged else ():
            if not (named := licences_of(rpn)):
                continue  # prose behind a tag
            expressions.append(" ".join(rpn))
            labels.update(named)
            asks.append(evaluate(rpn) or "unknown")
            miss *= 1 - TAG_WEIGHT
        for x in base:
            miss *= 1 - BASE_WEIGHT[x]
        joined_labels = lambda s: ",".join(sorted(x.replace(",", "") for x in s))
        most = max(asks, key=(*KINDS_OF, "unknown").index, default=None)
        return len(words), len(at), first, last, joined_labels(base), joined_labels(base | labels), round(1 - miss, 6), expressions, most


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, asks string"
KINDS = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.string()]
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "asks"]


def scan_licences(docs: DataFrame, extra: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Scan every whole text of ``docs`` (doc_id, text; other columns are not read): a row for each row.

    Null or empty text: 0 words, 0 places, null first_word and last_word, empty labels, score 0. Repeated
    rows are scanned one by one; an empty table gives no rows. ``extra``: more phrases, as words, with label and weight.
    expressions: the tags' licence expressions in reverse Polish order, in text order, of any length; one that names no
    known licence is prose and none. Labels are known licences only. asks: what the expressions ask for, the most of
    them (``unknown`` if one can't be told, null without any). One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(extra)
        for batch in batches:
            rows = [(doc, *scanner.scan(t.as_py())) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], names=NAMES)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "asks")


def brute_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """Base places by comparing word lists; for tests."""
    words = np.array(WORD.findall((text or "").translate(UPPER)), dtype=object).tolist()
    at, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
