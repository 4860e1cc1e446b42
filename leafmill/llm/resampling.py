"""Importance resampling toward a target distribution.

Words of documents and of target texts are counted by hashed bucket. A bucket's gain is the logarithm of its share in the target over that in the
corpus; the gains are one array of fixed size, and a document's weight is their sum over its words. With Gumbel noise added, the
greatest scores are a draw without replacement in proportion to the weights' exponentials.

The draw is exact and not one sort of everything: each task writes its eligible rows as sorted runs, cut at common
splitters (from a bounded sample of keys). Ranges are counted, those below the draw are not moved, and in each other
range a tournament tree merges its runs; the last range stops after the exact count. Ranks follow from the counts before.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage

#: Rows of a sorted run (48 bytes each): what a task holds.
RUN_ROWS = 1 << 18
#: Rows of a range, about, and ranges at most: each has a splitter, sent to every task.
RANGE_ROWS, RANGES = 1 << 14, 1 << 16
#: Keys that come to the driver for the splitters, about.
SAMPLED = 1 << 17
#: Rows of a run that a merge decodes at once.
PAGE = 1 << 10
#: Different words that a task counts or weighs before it begins anew.
WORDS = 1 << 17

SCORED = "doc_id long, n_features long, n_words long, weight long, score long, row long"
DRAWN = "doc_id long, n_features long, weight long, score long, rank long, row long"

#: Bytes to words: digits, lower-case letters and bytes beyond ASCII stay.
_LETTERS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS).split()


def features(found: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a space."""
    out = list(found)
    for k in range(2, longest + 1):
        out += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
    return out


def _counter(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(buckets, np.int64), Counter()

        def fold() -> None:
            at = np.fromiter((zlib.crc32(w) % buckets for w in seen), np.int64, len(seen))
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for b in batches:
            for text in b.column(0):
                seen.update(features(words(text.as_py()), longest))
                if len(seen) > WORDS:
                    fold()
        fold()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks add up their own; a row a bucket comes to the driver."""
    some = texts.select(F.col("text").cast("string")).mapInArrow(_counter(buckets, longest), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in some.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B)))) of each of the B buckets."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the digest of seed and id (no id: of an empty one)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """Feature to gain, looked up by its hash once."""

    def __init__(self, by_bucket: list[int]):
        self.by_bucket = by_bucket

    def __missing__(self, feature: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        gain = self[feature] = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        return gain


def _scorer(by_bucket, longest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = _Gains(by_bucket.value), TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = words(text.as_py())
                all_ = features(found, longest) if longest > 1 else found
                weight = sum(map(known.__getitem__, all_))
                out.append((doc, len(all_), len(found), weight, weight + noise(seed, doc), row))
                row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


# -- runs and their merge -------------------------------------------------------------------

#: Columns of a run: the first four are its key, smallest first (scores negated, no id after all ids).
_COLS = ("score", "none", "doc_id", "row", "n_features", "weight")


def _runs(splitters):
    """Sorted runs of a task's rows, each cut into the ranges that it has rows of: range, n, data (columns of 64-bit integers)."""

    def write(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held, axis=1)
        x = x[:, np.lexsort(x[3::-1])]
        cut = splitters.value  # keys that begin a range, in order
        both = np.concatenate([cut, x[:4]], axis=1)
        # A splitter comes before an equal key: its range begins with it.
        place = np.argsort(np.lexsort(np.vstack([np.r_[np.zeros(cut.shape[1]), np.ones(x.shape[1])], both[3::-1]])), kind="stable")[: cut.shape[1]]
        at = place - np.arange(cut.shape[1])
        ends = np.r_[at, x.shape[1]]
        begins = np.r_[0, at]
        some = np.flatnonzero(ends > begins)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array((ends - begins)[some]), pa.array([np.ascontiguousarray(x[:, i:j]).tobytes() for i, j in zip(begins[some], ends[some], strict=True)], pa.binary())], names=["range", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            col = {c: b.column(c) for c in b.schema.names}
            none = np.asarray(col["doc_id"].is_null()).astype(np.int64)
            cols = [-col["score"].to_numpy(), none, col["doc_id"].fill_null(0).to_numpy(), *(col[c].to_numpy() for c in _COLS[3:])]
            held.append(np.array(cols, np.int64))
            n += b.num_rows
            if n >= RUN_ROWS:
                yield write(held)
                held, n = [], 0
        if n:
            yield write(held)

    return run


class _Run:
    """A sorted run read a page at a time."""

    def __init__(self, data: bytes):
        self.x = np.frombuffer(data, np.int64).reshape(len(_COLS), -1)
        self.at = 0
        self.page: Iterator[tuple] = iter(())

    def next(self) -> tuple | None:
        row = next(self.page, None)
        if row is None and self.at < self.x.shape[1]:
            self.page = iter(list(zip(*self.x[:, self.at : self.at + PAGE].tolist(), strict=True)))
            self.at += PAGE
            row = next(self.page)
        return row


class Tournament:
    """k sorted runs in one order: each inner node keeps the loser of its match, so a new head plays on one path only."""

    def __init__(self, runs: list[_Run]):
        self.runs, k = runs, len(runs)
        self.heads = [r.next() for r in runs]
        self.tree = [-1] * k  # tree[0] is the winner
        win = [-1] * k + list(range(k))
        for i in range(k - 1, 0, -1):
            a, b = win[2 * i], win[2 * i + 1]
            win[i], self.tree[i] = (a, b) if self.before(a, b) else (b, a)
        if k:
            self.tree[0] = win[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x <= y

    def __iter__(self) -> Iterator[tuple]:
        k, tree, heads = len(self.runs), self.tree, self.heads
        while k and (row := heads[w := tree[0]]) is not None:
            yield row
            heads[w] = self.runs[w].next()
            i = (w + k) // 2
            while i:
                if self.before(tree[i], w):
                    tree[i], w = w, tree[i]
                i //= 2
            tree[0] = w


def _merger(before: dict[int, int], draw: int):
    """A range's runs in order, with ranks, up to the draw. before: rows of the ranges before each range."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, out = before[int(key[0])], []
        for rank, r in enumerate(Tournament([_Run(d) for d in rows["data"]]), first + 1):
            if rank > draw:
                break
            out.append((None if r[1] else r[2], r[4], r[5], -r[0], rank, r[3]))
        cols = dict(zip((c.split()[0] for c in DRAWN.split(", ")), zip(*out, strict=True) if out else [()] * 6, strict=True))
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in cols.items()})

    return merge


def draw_greatest(scored: DataFrame, eligible: str, percent: int) -> DataFrame:
    """``scored`` (SCORED, staged) with rank: floor(percent / 100) of the eligible rows, greatest scores first, then smaller ids."""
    spark, cols = scored.sparkSession, [c.split()[0] for c in DRAWN.split(", ")]
    rows = scored.where(eligible)
    n = rows.count()
    draw = percent * n // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*cols)

    share = min(1.0, SAMPLED / n)
    key = [(-F.col("score")).alias("score"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "row"]
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int(share * (1 << 40))).select(*key).toPandas().to_numpy(np.int64).reshape(-1, 4).T
    some = some[:, np.lexsort(some[::-1])]
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    at = np.unique(np.arange(1, ranges) * some.shape[1] // ranges)
    splitters = spark.sparkContext.broadcast(np.ascontiguousarray(some[:, at[at < some.shape[1]]]))

    runs, _ = stage(rows.select("score", "doc_id", "row", "n_features", "weight").mapInArrow(_runs(splitters), "range int, n long, data binary"), "runs")
    sizes = dict(runs.groupBy("range").agg(F.sum("n").alias("n")).collect())  # a row a range
    before, held = {}, 0
    for r in sorted(sizes):
        if held >= draw:
            break
        before[r] = held
        held += sizes[r]
    moved = runs.where(F.col("range") <= max(before))
    drawn, _ = stage(moved.groupBy("range").applyInPandas(_merger(before, draw), DRAWN), "drawn")
    last = drawn.where(F.col("rank") == draw).first()
    none, doc = int(last.doc_id is None), last.doc_id or 0
    after = F.struct(*key) > F.struct(F.lit(-last.score).cast("long").alias("score"), F.lit(none).cast("long").alias("none"), F.lit(doc).cast("long").alias("doc_id"), F.lit(last.row).cast("long").alias("row"))
    rest = scored.where(~F.expr(eligible) | after).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest.select(*cols))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """DRAWN: a row for each document, with rank 1, 2, 3, ... for those drawn and null for the others; row is unique.

    docs: needs doc_id and text; target: text. Other columns are not read. A null or empty text has no features, weighs nothing and is
    not eligible; a null id has the noise of an empty id and comes after all ids in ties; repeated rows and ids are drawn
    each by itself; an empty table of documents gives no rows, an empty target equal shares. Of N documents with at least ``min_words``
    words floor(percent * N / 100) are drawn.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    by_bucket = spark.sparkContext.broadcast(gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored, _ = stage(texts.mapInArrow(_scorer(by_bucket, longest, seed), SCORED), "scored")
    return draw_greatest(scored, f"n_words >= {int(min_words)}", percent)


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
w AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
h AS (SELECT w, hex(encode(w)) AS x FROM w),
k AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(1, length(x) + 1, 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1), lambda c, y: xor(t[xor(c % 256, y) + 1], c // 256), 4294967295)) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::BIGINT FROM t) AS t_all),
g AS (SELECT k.w, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (s_all + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
f AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN g USING (w) GROUP BY doc_id),
e AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, left(sha256(concat('2024:', d.doc_id)), 8) AS dg FROM d LEFT JOIN f USING (doc_id)),
z AS (SELECT *, list_reduce(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', dg[i]) - 1)::BIGINT), lambda a, y: 16 * a + y) AS hv FROM e),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((hv + 0.5) / 4294967296)))::BIGINT AS score FROM z),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT c.doc_id, n_features, weight, score, CASE WHEN r.rank <= 10 * r.n // 100 THEN r.rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""
