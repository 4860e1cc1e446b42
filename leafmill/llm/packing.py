"""Packing by power-of-two decomposition.

A document's ids are cut into runs of ``max_len`` and then into the binary digits of what is
left, longest first. Each piece is a sequence of its own, its length a power of two. Pieces of one length gather in a
bucket and leave it as batches of that length alone, so a batch has no padding, and no sequence crosses documents.

One narrow pass, no shuffle: a task keeps a bucket for each length (12 of them, of half a megabyte at most), a lost task is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory
from .encoding import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long"
#: Sequences are numbered within a task; the task's number stands above these bits.
TASK_BITS = 33
#: Bytes of ids in a batch: a bucket that holds so many is emptied.
BATCH_BYTES = 1 << 19
#: Rows in a batch at most: of short pieces, their other columns weigh more than ids.
BATCH_ROWS = 1 << 12


def lengths(n: int, max_len: int) -> list[int]:
    """``n`` as runs of ``max_len`` and falling powers of two. lengths(13, 8) == [8, 4, 1]"""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_power_of_two(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, bucket (the length's power of two) and batch_id (pieces of one batch have one length and follow
    each other).

    docs: needs doc_id and text; other columns are not read. A null or empty text is the end id
    alone, so each row gives at least one piece; repeated rows and ids are packed each by itself;
    an empty table gives no rows. ``max_len`` is a power of two. sequence_id is unique, not dense.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len is no power of two")
    end = end_id.to_bytes(4, "little")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(tokenizer), TaskContext.get().partitionId() << TASK_BITS
        batch_id = seq
        buckets: dict[int, list[tuple]] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + end
                n, at = len(ids) // 4, 0
                for length in lengths(n, max_len):
                    held = buckets.setdefault(length, [])
                    held.append((doc, at, length, ids[4 * at : 4 * (at + length)], n))
                    at += length
                    if 4 * length * len(held) >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield _batch(held, seq, batch_id)
                        seq, batch_id = seq + len(held), batch_id + 1
                        held.clear()
        for length in sorted(buckets):
            if held := buckets[length]:
                yield _batch(held, seq, batch_id)
                seq, batch_id = seq + len(held), batch_id + 1
        buckets.clear()
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _batch(pieces: list[tuple], sequence: int, batch_id: int) -> pa.RecordBatch:
    """A bucket's pieces (doc_id, start, length, ids, doc_tokens), of one length, each a sequence."""
    docs, starts, sizes, ids, tokens = zip(*pieces, strict=True)
    k, of_batch = len(pieces), np.full(len(pieces), sizes[0].bit_length() - 1, np.int32)
    cols = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(np.arange(sequence, sequence + k)), pa.array(np.zeros(k, np.int64)), pa.array(of_batch), pa.array(np.full(k, batch_id))]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with one folder for each bucket: a batch of a training step reads one of them."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """Ids replaced by their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id")
