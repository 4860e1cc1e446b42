"""Lines of a document that are nearly the same as others of it."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from leafmill.functions.text import let

SIMILARITY = 0.85
GAP = 0.25
#: Up to so many different lines of about one length, up to so long, are compared by counts of hashed pairs; beyond, by the index.
FEW, SHORT, BINS = 32, 2000, 512


def dice(a: str, b: str) -> float:
    """Twice the shared character pairs over all pairs, pairs counted as often as they occur. Texts whose
    lengths differ by more than a quarter are not compared; two empty texts are equal."""
    if not a or not b:
        return float(a == b)
    if abs(len(a) - len(b)) / max(len(a), len(b)) > GAP:
        return 0.0
    pairs = len(a) + len(b) - 2
    shared = Counter(zip(a, a[1:], strict=False)) & Counter(zip(b, b[1:], strict=False))
    return 2 * shared.total() / pairs if pairs else 0.0


def dice_similarity(a: Column, b: Column) -> Column:
    """``dice`` of two columns: counts of character pairs as maps, and the lesser count of each pair that both have."""
    n, m = F.length(a), F.length(b)

    def counts(text: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
        of = lambda xs: F.transform(F.array_distinct(xs), lambda p: F.struct(p, F.size(xs) - F.size(F.array_remove(xs, p))))
        return let(pairs, lambda xs: F.map_from_entries(of(xs)))

    def shared(x: Column, y: Column) -> Column:
        return F.aggregate(F.map_keys(x), F.lit(0), lambda acc, p: acc + F.least(x[p], F.coalesce(F.try_element_at(y, p), F.lit(0))))

    overlap = let(counts(a), lambda x: let(counts(b), lambda y: shared(x, y)))
    far = F.abs(n - m) / F.greatest(n, m) > GAP
    plain = F.when((n == 0) | (m == 0), (a == b).cast("double")).when(far | (n + m == 2), F.lit(0.0))
    return plain.otherwise(2 * overlap / (n + m - 2))


class _Pairs:
    """Different lines of about one length with their pairs of characters as a set: the k-th time that a pair occurs in a line
    is a token of its own, so what two lines share is the size of an intersection. Tokens are numbered rare ones first."""

    def __init__(self, lines: list[str]):
        seen = [Counter(zip(x, x[1:], strict=False)) for x in lines]
        lines_with = Counter((p, k) for c in seen for p, n in c.items() for k in range(n))
        number = {t: i for i, (t, _) in enumerate(sorted(lines_with.items(), key=lambda x: x[1]))}
        tokens = [sorted(number[p, k] for p, n in c.items() for k in range(n)) for c in seen]
        self.lengths = np.array([len(x) for x in lines])
        self.first = np.r_[0, np.cumsum([len(t) for t in tokens])]
        self.tokens = np.array([t for ts in tokens for t in ts], np.int64)
        self.mark = np.zeros(len(number) + 1, bool)
        # Lines by token, prefixes alone: two lines that are alike share a token of both prefixes.
        least = int(self.lengths.min())
        posted: dict[int, list[int]] = defaultdict(list)
        self.prefix = []
        for i, t in enumerate(tokens):
            need = math.ceil(SIMILARITY * (len(t) + least - 1) / 2 - 1e-9)
            self.prefix.append(t[: len(t) - max(need, 1) + 1])
            for x in self.prefix[-1]:
                posted[x].append(i)
        self.posted = {x: np.array(v) for x, v in posted.items()}

    def alike(self, i: int, free: np.ndarray) -> np.ndarray:
        """Free lines that are like line ``i``, in order."""
        met = [self.posted[x] for x in self.prefix[i]]
        if not met:
            return np.zeros(0, np.int64)
        found = np.zeros(len(free), bool)
        found[np.concatenate(met)] = True
        n = self.lengths
        found &= free & (np.abs(n - n[i]) / np.maximum(n, n[i]) <= GAP)
        found[i] = False
        near = np.flatnonzero(found)
        if not len(near):
            return near
        mine = self.tokens[self.first[i] : self.first[i + 1]]
        self.mark[mine] = True
        sizes = self.first[near + 1] - self.first[near]
        at = np.repeat(self.first[near] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        shared = np.add.reduceat(self.mark[self.tokens[at]].astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
        self.mark[mine] = False
        return near[2 * shared / (n[near] + n[i] - 2) >= SIMILARITY]


class _Counts:
    """A few different lines of about one length. Character pairs are counted in bins: what two lines share in their bins is no less than the pairs
    that they share, so only lines that may be alike by it are compared by ``dice``."""

    def __init__(self, lines: list[str], counts: np.ndarray):
        self.lines = lines
        n = np.array([len(x) for x in lines])
        bound = np.minimum(counts[:, None], counts[None]).sum(-1, dtype=np.int64)
        self.may = 2 * bound / (n[:, None] + n - 2) >= SIMILARITY

    def alike(self, i: int, free: np.ndarray) -> np.ndarray:
        """Free lines that are like line ``i``, in order."""
        return np.array([j for j in np.flatnonzero(self.may[i] & free) if j != i and dice(self.lines[i], self.lines[j]) >= SIMILARITY], np.int64)


def _binned(lines: list[str]) -> np.ndarray:
    """Counts of each line's character pairs by bin; lines have two characters or more."""
    n = np.array([len(x) for x in lines])
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(lines)), n)
    within = row[1:] == row[:-1]
    pairs = (c[:-1] * 31 + c[1:] * 7919) % BINS
    return np.bincount((row[:-1] * BINS + pairs)[within], minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.int32)


def fuzzy_repeats(lines: list[str], threshold: int) -> list[bool]:
    """Which lines belong to a group of ``threshold`` lines or more that are alike.

    Lines of about one length (fives) are taken in order; each that isn't in a group yet leads one with all later
    ones that are like it, and these lead no group of their own, even if the group is too small. Equal lines are one
    for the search, which meets only lines that share a rare pair of characters with the leader."""
    out, by_length = [False] * len(lines), defaultdict(list)
    for i, line in enumerate(lines):
        if len(t := line.strip(" \t\r\n")) >= 5:
            by_length[len(t) // 5].append((i, t))
    for rows in by_length.values():
        if len(rows) < threshold:
            continue
        places: dict[str, list[int]] = {}
        for i, t in rows:
            places.setdefault(t, []).append(i)
        copies, texts = list(places.values()), list(places)
        if len(texts) == 1:
            pairs = None
        else:
            pairs = _Counts(texts, _binned(texts)) if len(texts) <= FEW and len(texts[0]) <= SHORT else _Pairs(texts)
        free = np.ones(len(copies), bool)
        # A line that is taken is taken with all its copies: what is like one is like the others.
        for k in range(len(copies)):
            if not free[k]:
                continue
            like = pairs.alike(k, free) if pairs else ()
            free[k] = False
            free[list(like)] = False
            group = [*copies[k], *(i for m in like for i in copies[m])]
            if len(group) >= threshold:
                for i in group:
                    out[i] = True
    return out


@F.pandas_udf(ArrayType(BooleanType()))
def fuzzy_flags(lines: pd.Series, threshold: pd.Series) -> pd.Series:
    """fuzzy_repeats of each document: its order matters, so it can't be a join."""
    return pd.Series([fuzzy_repeats(list(x), int(t)) for x, t in zip(lines, threshold, strict=True)])
