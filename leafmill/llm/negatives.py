"""Hard negatives by a kNN join over Voronoi cells.

A vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and an anchor q a zero. Then
|q - x|^2 = |q|^2 + M - 2 (q, x): the largest inner products are the nearest neighbours, and distances obey the triangle inequality.

1. Pivots are a bounded sample of the vectors. Each vector belongs to the cell of its nearest pivot; a cell's vectors
   lie in blocks of bounded bytes, each with its least and greatest distance from the pivot.
2. Anchors of one cell form groups of about GROUP. A group searches its own cell first: the fifth positive found there
   is a score that the fifth of all reaches too.
3. A score to be reached is a distance t not to be passed. A block of cell j is sent to a group only if one of its anchors q may
   need it: its ring about the pivot meets [d(q, p_j) - t, d(q, p_j) + t], and the plane between the pivots of q
   and j isn't farther from q than t. What is sent is joined exactly, in integers.
4. The positives then give each anchor its bands of scores, these give new bounds, and negatives are searched the same way.

Blocks sent to a group are dealt out by salt, so neither a large cell nor a large group is one task; each task keeps the best few of
each anchor, and only these are merged. Unlike neighbours in many dimensions bounds exclude little: then each group meets all
blocks, as it must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stage

#: Anchors in a group, about.
GROUP = 256
#: Bytes of a block's vectors: rows of an Arrow batch are bounded, and so are its bytes.
BLOCK_BYTES = 1 << 16
#: Vectors that a task holds back to sort them into blocks.
HELD_ROWS = 1 << 16
#: Pivots: at least, and at most (they are sent to every task), and anchors for each between these.
PIVOTS, MOST_PIVOTS, ANCHORS_A_PIVOT = 8, 1024, 64
#: Blocks that a group meets in one task, about.
TASK_BLOCKS = 64
#: Found neighbours that a task holds before it drops all but the best.
HELD_HITS = 1 << 18
#: Up to this squared norm inner products are exact in doubles.
EXACT = 2**52
LOW, HIGH = -(2**63) + 1, 2**63 - 1

FOUND = "anchor long, band int, score long, vec_id long, row long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class _Space:
    """Pivots in the space with one more component, and how vectors are kept as bytes."""

    def __init__(self, pivots: np.ndarray, norm: int, dims: int):
        self.norm, self.dims = norm, dims
        self.kind = "<i2" if norm < 2**30 else "<i4" if norm < 2**62 else "<i8"
        self.slack = 1e-6 * np.sqrt(norm) + 1e-6
        self.pivots = self.lifted(pivots)
        apart = np.maximum(2 * norm - 2 * self.pivots @ self.pivots.T, 0)
        self.apart = np.sqrt(apart)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))]

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From each vector (or anchor) to each pivot."""
        if anchors:
            x = x.astype(np.float64)
            square = (x * x).sum(1)[:, None] + self.norm - 2 * x @ self.pivots[:, :-1].T
        else:
            square = 2 * self.norm - 2 * self.lifted(x) @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.dims)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.norm <= EXACT:
            return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows; what a list lacks is 0."""
    sizes = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(space):
    """Vectors into blocks of one cell: block, cell, near, far, n, ids (vec_id, row and label of each), data."""

    def cut(held: list[tuple], first: int) -> pa.RecordBatch | None:
        s = space.value
        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        d = s.distances(x, False)
        cell = d.argmin(1)
        own = d[np.arange(len(x)), cell]
        order = np.lexsort((own, cell))
        ids, x, cell, own = ids[order], x[order].astype(s.kind), cell[order], own[order]
        step = max(1, BLOCK_BYTES // max(1, x.itemsize * s.dims))
        rows = []
        for c in np.unique(cell):
            lo, hi = np.searchsorted(cell, [c, c + 1])
            for i in range(lo, hi, step):
                j = min(i + step, hi)
                rows.append((first + len(rows), int(c), float(own[i]), float(own[j - 1]), j - i, ids[i:j].tobytes(), x[i:j].tobytes()))
        names = ["block", "cell", "near", "far", "n", "ids", "data"]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, first = [], 0, TaskContext.get().partitionId() << 33
        for b in batches:
            ids = np.c_[tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row", "label"))].astype("<i8")
            held.append((ids, _matrix(b.column("q"), space.value.dims)))
            n += b.num_rows
            if n >= HELD_ROWS:
                out = cut(held, first)
                yield out
                held, n, first = [], 0, first + out.num_rows
        if n:
            yield cut(held, first)

    return run


def _homes(space):
    """Anchors with their cell and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("q"), space.value.dims)
            cell = space.value.distances(x, True).argmin(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            data = pa.array([r.tobytes() for r in x.astype(space.value.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), pa.array(cell), data], names=["row", "vec_id", "label", "cell", "data"])

    return run


def _pack(space):
    """A group's anchors as one row: ids (row, label), bands (least and greatest score of each), data, and for each cell that it
    needs the interval of distances from the pivot."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = space.value
        rows = rows.sort_values("row")
        x = s.matrix(b"".join(rows["data"]))
        low, high = (np.array(rows[c].tolist(), np.int64).reshape(len(rows), -1) for c in ("low", "high"))
        need = np.where(low <= high, low, HIGH).min(1)
        cells, lo, hi = _reach(s, x, int(key[0]), need)
        ids = np.c_[rows["row"], rows["label"]].astype("<i8").tobytes()
        bands = np.stack([low, high], 2).astype("<i8").tobytes()
        return pd.DataFrame({"group": [int(key[0]) << 32 | int(key[1])], "home": [int(key[0])], "ids": [ids], "bands": [bands], "data": [x.tobytes()], "cells": [cells], "lo": [lo], "hi": [hi]})

    return pack


def _reach(s: _Space, x: np.ndarray, home: int, need: np.ndarray) -> tuple[list, list, list]:
    """Cells that may hold a vector of the score that an anchor needs (LOW: any), with intervals of distances from their pivots."""
    d = s.distances(x, True)
    square = (x.astype(np.float64) ** 2).sum(1) + s.norm - 2 * need.astype(np.float64)
    t = np.where(need == LOW, np.inf, np.sqrt(np.maximum(square, 0))) + s.slack
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - d[:, home : home + 1] ** 2) / (2 * s.apart[home])
    wanted = ~(plane > t[:, None] + s.slack) & (need != HIGH)[:, None]  # pivots in one place part nothing
    wanted[:, home] = need != HIGH
    cells = np.flatnonzero(wanted.any(0))
    lo = np.where(wanted, d - t[:, None], np.inf).min(0)[cells]
    hi = np.where(wanted, d + t[:, None], -np.inf).max(0)[cells]
    return cells.tolist(), lo.tolist(), hi.tolist()


def _best(hits: list[tuple], k: int) -> tuple:
    """The first k of each slot: greater scores, then smaller ids, then rows. hits: arrays slot, score, vec_id, row."""
    slot, score, vec, row = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((row, vec, -score, slot))
    slot = slot[order]
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
    keep = order[place < k]
    return slot[place < k], score[keep], vec[keep], row[keep]


def _search(space, k: int, same: bool):
    """Rows of one group and salt follow each other, the group's own first: its anchors against block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, anchors, hits, held, floor = space.value, None, [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if hits:
                slot, score, vec, row = _best(hits, k)
                n = bands.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[slot // n, 0], (slot % n).astype(np.int32), score, vec, row)], names=["anchor", "band", "score", "vec_id", "row"])

        for b in batches:
            for i in range(b.num_rows):
                mine, data = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("ids", "bands")), b.column("data")[i].as_py()
                mine, limits = mine
                if len(limits):  # a group begins
                    if anchors is not None:
                        yield from out()
                    anchors, ids, bands = s.matrix(data), mine.reshape(-1, 2), limits.reshape(len(mine) // 2, -1, 2)
                    hits, held, floor = [], 0, bands[:, :, 0].copy()
                    continue
                other = mine.reshape(-1, 3)
                score = s.scores(anchors, s.matrix(data))
                fits = (ids[:, 1:] == other[:, 2]) & (ids[:, :1] != other[:, 1]) if same else ids[:, 1:] != other[:, 2]
                for j in range(bands.shape[1]):
                    ok = fits & (score >= floor[:, j : j + 1]) & (score <= bands[:, j, 1:])
                    if score.shape[1] > k:
                        kth = np.partition(np.where(ok, score, LOW), -k, axis=1)[:, -k]
                        ok &= score >= kth[:, None]
                    a, c = np.nonzero(ok)
                    if len(a):
                        hits.append((a * bands.shape[1] + j, score[a, c], other[c, 0], other[c, 1]))
                        held += len(a)
                if held >= HELD_HITS:
                    hits = [_best(hits, k)]
                    held, (slot, found) = len(hits[0][0]), hits[0][:2]
                    full = np.flatnonzero(np.bincount(slot, minlength=floor.size) == k)
                    least = np.full(floor.size, HIGH, np.int64)
                    np.minimum.at(least, slot, found)
                    floor.reshape(-1)[full] = least[full]
        if anchors is not None:
            yield from out()

    return run


def _serve(blocks: DataFrame, anchors: DataFrame, space, k: int, same: bool, name: str, home_only: bool = False) -> DataFrame:
    """FOUND rows: the best k of each anchor and band (arrays low and high of anchors) among blocks that may serve it."""
    groups, _ = stage(anchors.groupBy("cell", "salt").applyInPandas(_pack(space), "group long, home int, ids binary, bands binary, data binary, cells array<int>, lo array<double>, hi array<double>"), f"{name}-groups")
    reach = groups.select("group", "home", F.explode(F.arrays_zip("cells", "lo", "hi")).alias("x")).select("group", "home", F.col("x.cells").alias("cell"), "x.lo", "x.hi")
    if home_only:
        reach = reach.where("cell = home")
    salts = max(1, -(-blocks.count() // TASK_BLOCKS))
    dealt = (F.pmod(F.xxhash64("block"), F.lit(salts))).cast("int").alias("salt")
    pairs = reach.join(blocks.select("block", "cell", "near", "far"), "cell").where("far >= lo and near <= hi").select("group", "block")
    sent = pairs.join(blocks, "block").select("group", dealt, F.lit(1).alias("kind"), "ids", F.lit(b"").alias("bands"), "data")
    own = groups.select("group", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "ids", "bands", "data")
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = own.unionByName(sent).repartition(tasks, "group", "salt").sortWithinPartitions("group", "salt", "kind")
    found = rows.select("ids", "bands", "data").mapInArrow(_search(space, k, same), FOUND)
    best = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """A row for each anchor, positive and rank: OUT.

    vectors: needs vec_id, label (integers) and embedding (array of numbers); other columns are read by ``anchor`` alone, a
    condition on the row. A component x becomes floor(scale * x), and a score is the inner product of two such vectors. An anchor's positives are its
    first other rows of its label; of rows with another label the first are returned whose score is between ``lower`` and ``upper``
    hundredths of the positive's, both included. Greater scores come first, then smaller vec_ids, then any order.

    Rows without a vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths
    are filled with zeros; an empty one is zero. Repeated rows and ids take part each by itself: an
    anchor is not its own positive, its copy is. No anchors or no vectors give no rows. Squared norms beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    number = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    use = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    whole = F.transform(number, lambda x: F.floor(x * scale).cast("long"))
    rows = vectors.where(use).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("q"))
    rows, _ = stage(rows, "vectors")
    square = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x)
    total = rows.agg(F.max(square).alias("norm"), F.max(F.size("q")).alias("dims"), F.count_if("anchor").alias("anchors")).first()
    if not total.anchors:
        return spark.createDataFrame([], OUT)

    count = int(min(max(total.anchors // ANCHORS_A_PIVOT, PIVOTS), MOST_PIVOTS))
    some = rows.select("q", F.xxhash64("vec_id").alias("h"), "row").orderBy("h", "row").limit(4 * count).collect()
    dims = max(1, total.dims)
    pivots = np.zeros((len(some), dims), np.int64)
    for i, r in enumerate(some):
        pivots[i, : len(r.q)] = r.q
    pivots = pivots[np.sort(np.unique(pivots, axis=0, return_index=True)[1])][:count]  # copies are one place
    space = spark.sparkContext.broadcast(_Space(pivots, total.norm, dims))

    blocks, _ = stage(rows.select("vec_id", "row", "label", "q").mapInArrow(_blocks(space), "block long, cell int, near double, far double, n int, ids binary, data binary"), "blocks")
    homes, _ = stage(rows.where("anchor").select("row", "vec_id", "label", "q").mapInArrow(_homes(space), "row long, vec_id long, label long, cell int, data binary"), "homes")
    parts = dict(homes.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("parts")).collect())  # a row for each pivot at most
    split = F.create_map(*[F.lit(int(v)) for kv in parts.items() for v in kv])
    homes = homes.withColumn("salt", F.pmod(F.xxhash64("row"), split[F.col("cell")]))
    of = lambda low, high: (F.array(low).alias("low"), F.array(high).alias("high"))
    any_score = (F.lit(LOW), F.lit(HIGH))

    near = _serve(blocks, homes.select("*", *of(*any_score)), space, positives, True, "near", home_only=True)
    reached = near.where(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("reached"))
    reached, _ = stage(reached, "reached")
    bounded = homes.join(reached, "row", "left").select(homes["*"], *of(F.coalesce("reached", any_score[0]), any_score[1]))
    found, _ = stage(_serve(blocks, bounded, space, positives, True, "positive"), "positives")

    # Of each positive the band of scores; a null positive is an empty band.
    by = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("found"))  # a few each
    at = lambda i, c: F.get("found", F.lit(i))[c]
    low = [F.coalesce(F.ceil(lower * at(i, "score") / F.lit(100).cast("decimal(3,0)")).cast("long"), F.lit(1)) for i in range(positives)]
    high = [F.coalesce(F.floor(upper * at(i, "score") / F.lit(100).cast("decimal(3,0)")).cast("long"), F.lit(0)) for i in range(positives)]
    banded = homes.join(by.withColumnRenamed("anchor", "row"), "row").select(homes["*"], F.array(*low).alias("low"), F.array(*high).alias("high"))
    wanted = banded.where(F.exists(F.arrays_zip("low", "high"), lambda x: x["low"] <= x["high"]))
    last = _serve(blocks, wanted, space, negatives, False, "negative")

    named = found.join(homes.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("band"))
    return last.select("anchor", "band", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "band"]).select(*(c.split()[0] for c in OUT.split(", ")))


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5"""


def mine(embeddings: DataFrame) -> DataFrame:
    """The query's rows: a seventh of the labels moved on by one, each hundredth vector an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
