"""Best-two-fit packing of whole documents into sequences.

Lengths are at most ``max_len``, so how often each occurs is all that a plan needs, and it is bounded whatever the corpus. The plan fills a
bin with the greatest lengths that fit, then gives up its smallest document for two others that fill the wider gap more tightly; the
same choices hold for as many bins as the counts allow, and these are planned at once. What comes out are runs: of length l, documents
number a to b go into bins from c on, k to a bin, at an offset.

Documents are numbered within their length without gathering a length anywhere: tasks number their own and write the pieces, the tasks' counts
are added up by length, and each piece's number is the sum before its task plus its own. Bins then follow from the plan by a search.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, stage
from .encoding import encoder

CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"
#: Bytes of ids, and rows, in a batch.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1 << 12
#: A length and a document's number in one 64-bit key.
NUMBER_BITS = 48
#: Runs: length, first number, documents, first bin, to a bin, offset.
RUN_COLUMNS = 6


def cuts(n: int, max_len: int) -> list[int]:
    """``n`` ids as pieces: the rest first, then whole ones. cuts(5, 2) == [1, 2, 2]"""
    return ([n % max_len] if n % max_len else []) + [max_len] * (n // max_len)


def _take(counts: dict[int, int], lengths: list[int], length: int, k: int) -> None:
    counts[length] -= k
    if not counts[length]:
        lengths.remove(length)


def _put(counts: dict[int, int], lengths: list[int], length: int) -> None:
    if not counts.get(length):
        lengths.insert(bisect_right(lengths, length), length)
    counts[length] = counts.get(length, 0) + 1


def _two_for(counts: dict[int, int], lengths: list[int], gap: int, more_than: int) -> tuple[int, int] | None:
    """Two lengths that together fill most of ``gap``, and more than ``more_than`` of it."""
    best = None
    for a in reversed(lengths[: bisect_right(lengths, gap - 1)]):
        if 2 * a <= more_than:
            break
        at = bisect_right(lengths, min(a, gap - a)) - 1
        if at >= 0 and lengths[at] == a and counts[a] < 2:
            at -= 1
        if at >= 0 and a + lengths[at] > more_than:
            best, more_than = (a, lengths[at]), a + lengths[at]
            if more_than == gap:
                break
    return best


def plan(counts: dict[int, int], max_len: int) -> np.ndarray:
    """Runs (RUN_COLUMNS) that put ``counts[length]`` documents of each length into bins of ``max_len``, sorted by length and number."""
    left, lengths = {n: c for n, c in counts.items() if c}, sorted(n for n, c in counts.items() if c)
    number, bins, runs = dict.fromkeys(lengths, 0), 0, []
    while lengths:
        before = dict(left)
        filled: dict[int, int] = {}  # what this bin holds
        need: dict[int, int] = {}  # what choosing it took
        gap = max_len
        while (at := bisect_right(lengths, gap) - 1) >= 0:
            n = lengths[at]
            k = min(gap // n, left[n])
            _take(left, lengths, n, k)
            filled[n], need[n], gap = k, k, gap - k * n
        while gap and filled:
            least = min(filled)
            _put(left, lengths, least)
            pair = _two_for(left, lengths, gap + least, least)
            if not pair:
                _take(left, lengths, least, 1)
                break
            filled[least] -= 1
            if not filled[least]:
                del filled[least]
            for n in pair:
                _take(left, lengths, n, 1)
                filled[n], need[n] = filled.get(n, 0) + 1, need.get(n, 0) + 1
            gap += least - sum(pair)
        # As long as all that was chosen from is there, the next bin is filled alike.
        times = max(1, min((before[n] - need[n]) // k + 1 for n, k in filled.items()))
        for n, k in filled.items():
            if times > 1:
                _take(left, lengths, n, (times - 1) * k)
        offset = 0
        for n in sorted(filled, reverse=True):
            runs.append((n, number[n], times * filled[n], bins, filled[n], offset))
            number[n] += times * filled[n]
            offset += n * filled[n]
        bins += times
    out = np.array(runs, np.int64).reshape(-1, RUN_COLUMNS)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _cutter(tokenizer: str, max_len: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen, rows, held = np.zeros(max_len + 1, np.int64), [], 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CUT.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, at = enc.encode(text.as_py()) + end, 0
                for piece, n in enumerate(cuts(len(ids) // 4, max_len)):
                    some = ids[4 * at : 4 * (at + n)]
                    rows.append((doc, piece, at, n, zlib.crc32(some), task, int(seen[n]), some))
                    seen[n] += 1
                    at += n
                    held += len(some)
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()
        del rows
        release_memory()

    return run


def _placer(runs, max_len: int):
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = runs.value
        keys = table[:, 0] << NUMBER_BITS | table[:, 1]
        for length, number in batches:
            n, i = length.to_numpy(np.int64), number.to_numpy(np.int64)
            r = table[np.searchsorted(keys, n << NUMBER_BITS | i, "right") - 1]
            nth = i - r[:, 1]
            yield pd.DataFrame({"sequence_id": r[:, 3] + nth // r[:, 4], "offset": r[:, 5] + nth % r[:, 4] * n})

    return F.pandas_udf(place, "sequence_id long, offset long")


def pack_best_two_fit(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id (from 0, dense), offset.

    docs: needs doc_id and text; other columns are not read. A document's ids end in ``end_id``; a null or empty text is that alone, so each row
    gives a piece. Longer documents than ``max_len`` are cut into pieces of that length behind a first one of the rest. Repeated
    rows and ids are packed each by itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut, _ = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cutter(tokenizer, max_len, end_id), CUT), "cut")
    of_task, _ = stage(cut.groupBy("task", "length").agg(F.max("nth").alias("last")).select("task", "length", (F.col("last") + 1).alias("n")), "counts")
    counts = dict(of_task.groupBy("length").agg(F.sum("n").alias("n")).collect())  # max_len rows at most
    runs = spark.sparkContext.broadcast(plan(counts, max_len))
    # A row for each task and length: a window over a length has as many rows as there were tasks.
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = of_task.select("task", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    at = _placer(runs, max_len)("length", F.col("before") + F.col("nth")).alias("at")
    placed = cut.join(base, ["task", "length"]).withColumn("at", at)
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed sequences: sequence_id, length, ids of its pieces in order, and their doc_ids and lengths. One is ``max_len`` ids at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
