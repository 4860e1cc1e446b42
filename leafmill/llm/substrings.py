"""Suffix-array deduplication with a run-length index.

Which 200-byte strings start more than once is decided by run-compressed Burrows-Wheeler transforms,
each over a bin of the corpus; the bins are made so that equal strings always share one:

1. Each 200-byte window belongs to the 40-byte gram of the least hash in it (the leftmost of equals),
   its anchor. Equal windows have equal anchors. Consecutive windows of one anchor are a segment of at
   most 161 windows; no window is in two segments.
2. Anchors met once are dropped: their windows are unique. Of the others, each distinct segment goes once, with the number
   of its copies, to the bin that the anchor's hash names.
3. A bin's texts are concatenated and their BWT is run-compressed. n copies of a text add to its runs' lengths, not to
   their number, so they cost no space: each of their suffixes matches the copy's to the end. At both ends of each run the
   text position and the length of the match with the neighbouring suffix are sampled. Within a run these
   lengths fall by one for each step in the text, so one pass over the text streams, from the samples
   alone, the matching statistic of every position: the longest match that starts elsewhere too.
   Positions with 200 or more are marked.
4. Marks go back to the documents, their union is cut out.

Texts are kept beside the shuffle as chunk files (of the documents of one scan task each) in the shared folder, so only
hashes and the distinct segments of anchors that are met again are shuffled. Copies of a segment are told by 128 bits, its
anchor's hash and its own. An anchor with more than HOT distinct segments doesn't go to one bin: its windows are counted by
hash, with partial aggregation, however many they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, file_system, mix64, put, release_memory, sized_broadcast, stage, workspace

LENGTH = 200
GRAM = 40
#: Anchors are found in blocks of so many bytes at most (positions take 17 bits of the sort key).
BLOCK = 1 << 17
#: Bytes of segments in a bin, about.
BIN_BYTES = 1 << 20
#: Distinct segments of an anchor from which its windows are counted one by one.
HOT = 4096
SEPARATOR = 255  # in no UTF-8 text
#: Bytes of text in a batch of a chunk file, and in a chunk file, about: a task that cuts texts holds one chunk.
BATCH_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
#: Documents in a chunk at most; empty ones have no bytes.
CHUNK_DOCS = 1 << 18
#: Rows of a batch of a chunk file at most.
PART_ROWS = 1 << 12
#: A document's key: its number in the chunk; above it the chunk's number in the task, above that the task attempt's. So rows
#: that an attempt has given name the chunks that it has written, whatever another attempt did.
DOC_BITS, CHUNK_BITS = 18, 12
#: Bins that one task works off, about.
TASK_BINS = 8
#: Rows of the table of hot anchors (8 bytes each; a row for HOT segments at least) up to which it is broadcast.
BROADCAST_ROWS = 500_000


# -- anchors and segments -------------------------------------------------------------------


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """64-bit hash of each GRAM-byte gram of a uint8 array."""
    n = len(a) - GRAM + 1
    x = np.ndarray((len(a) - 7,), "<u8", a, strides=(1,)).copy()
    x ^= x >> np.uint64(31)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM // 8):
            h += x[8 * j : 8 * j + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) % 2**64 | 1)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, s = x, 1
    while 2 * s <= width:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - s : width - s + n])


def segments(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, windows) of the segments of a text, by blocks."""
    width = length - GRAM + 1
    for base in range(0, max(0, len(data) - length + 1), BLOCK - length + 1):
        a = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - base), base)
        k = gram_hashes(a)
        key = (k & ~np.uint64(BLOCK - 1)) | np.arange(len(k), dtype=np.uint64)
        at = (sliding_min(key, width) & np.uint64(BLOCK - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield k[at[first]].view(np.int64), first + base, np.diff(np.r_[first, len(at)])


# -- run-length index -----------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling from 7-byte words; later rounds sort tied suffixes only."""
    n = len(text)
    # Nine bits a byte: 0 stands for what is beyond the end.
    padded, word = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(6, np.uint64)], np.zeros(n, np.uint64)
    for j in range(7):
        word = (word << np.uint64(9)) | padded[j : j + n]
    sa = np.argsort(word)
    ordered = word[sa]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 7
    while True:
        # Places in the order whose rank is shared.
        place = np.flatnonzero(~head | np.r_[~head[1:], False])
        if not len(place):
            return sa
        idx = sa[place]
        key = (rank[idx].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(idx + k, n)] + 1).astype(np.uint64)
        order = np.argsort(key)
        sa[place] = idx[order]
        key = key[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        head[place] = fresh
        rank[sa[place]] = np.maximum.accumulate(np.where(fresh, place, 0))
        k *= 2


class RunLengthIndex:
    """The run-compressed BWT of a byte text by the samples at the ends of its runs: text positions, and the lengths of the
    matches beyond. times: copies that the text at each position stands for; rest: bytes up to that text's end."""

    def __init__(self, text: np.ndarray, times: np.ndarray | None = None, rest: np.ndarray | None = None):
        self.times, self.rest = times, rest
        sa = suffix_array(text)
        bwt = text[sa - 1]
        head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        # The suffix at text position 0 has no character before it, so its run is cut.
        zero = int(np.flatnonzero(sa == 0)[0])
        head = np.union1d(head, [z for z in (zero, zero + 1) if z < len(sa)])
        tail = np.r_[head[1:], len(sa)] - 1
        self.n, self.runs = len(text), len(head)
        self.heads = self._samples(text, sa, head[head > 0], -1)
        self.tails = self._samples(text, sa, tail[tail < len(sa) - 1], 1)

    @staticmethod
    def _samples(text: np.ndarray, sa: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of run ends, ascending, and their matches with the suffix beyond."""
        p, q = sa[at], sa[at + step]
        match, live = np.zeros(len(p), np.int64), np.arange(len(p))
        padded = np.r_[text, np.zeros(8, np.uint8)]
        words = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
        n = len(text)
        while len(live):
            a, b = p[live] + match[live], q[live] + match[live]
            diff = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            same = np.minimum(same, n - np.maximum(a, b))
            match[live] += same
            live = live[(same == 8)]
        order = np.argsort(p)
        return p[order], match[order]

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match that starts at another position too."""
        best = np.zeros(self.n, np.int64)
        where = np.arange(self.n)
        for p, match in (self.heads, self.tails):
            if len(p):
                at = np.searchsorted(p, where, "right") - 1
                best = np.maximum(best, np.where(at >= 0, match[at] + p[at] - where, 0))
        return best if self.times is None else np.where(self.times > 1, np.maximum(best, self.rest), best)


def mark_bin(texts: list[bytes], length: int = LENGTH, times: list[int] | None = None) -> list[np.ndarray]:
    """For each text, the starts of windows that start elsewhere in the bin too. times: copies of each text."""
    joined = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.repeat(np.cumsum(sizes) - 1, sizes)
    copies = np.repeat(np.array(times or [1] * len(texts)), sizes)
    ms = RunLengthIndex(joined, copies, ends - np.arange(len(joined))).matching_statistics()
    out, at = [], 0
    for t in texts:
        n = max(0, len(t) - length + 1)
        out.append(np.flatnonzero(ms[at : at + n] >= length))
        at += len(t) + 1
    return out


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending integers as half-open runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + 1).tolist(), strict=True))


# -- plan -----------------------------------------------------------------------------------


def _segment_rows(h, t, doc, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(t, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64())], names=["h", "t", "doc", "at"])


class _Chunk:
    """A chunk file as it is written; its segments are returned as they are found."""

    def __init__(self, folder: str, number: int, schema: pa.Schema):
        self.key, self.docs, self.bytes = number << DOC_BITS, 0, 0
        self.fs, self.path = _chunk_path(folder, number)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, part: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
        self.out.write_batch(part)
        hs, ts, docs, ats = [], [], [], []
        for text in part.column("text").cast(pa.binary()):
            data = text.as_py() or b""
            for h, first, count in segments(data, length):
                hs.append(h)
                ts.append(np.array([xxhash.xxh3_64_intdigest(data[s : s + c + length - 1]) for s, c in zip(first.tolist(), count.tolist(), strict=True)], np.uint64).view(np.int64))
                docs.append(np.full(len(h), self.key + self.docs))
                ats.append((first << 16) + count)
            self.docs += 1
            self.bytes += len(data)
        if hs:
            yield _segment_rows(*map(np.concatenate, (hs, ts, docs, ats)))

    def close(self) -> pa.RecordBatch:
        """Give the file its name; returns the chunk's own row, which has no anchor."""
        self.out.close()
        self.sink.close()
        put(self.fs, self.tmp, self.path)
        return _segment_rows([None], [None], [self.key], [0])


def _chunk_path(folder: str, chunk: int) -> tuple:
    fs, base = file_system(folder)
    return fs, f"{base}/chunk-{chunk:08d}.arrow"


def _read_chunk(folder: str, chunk: int) -> Iterator[pa.RecordBatch]:
    fs, path = _chunk_path(folder, chunk)
    with fs.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def _documents(folder: str, chunk: int) -> Iterator[tuple[int, bytes, pa.RecordBatch, int]]:
    """(number in chunk, text in UTF-8, batch, row of the batch)"""
    n = 0
    for batch in _read_chunk(folder, chunk):
        for i, t in enumerate(batch.column("text").cast(pa.binary())):
            yield n, t.as_py() or b"", batch, i
            n += 1


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else.

    docs: needs doc_id and text. A row for each row: doc (a struct of all its columns), text (what is left;
    characters that a cut has broken are left out), n_bytes, n_removed, n_spans, kept_sha256 (of the bytes
    left), spans (removed runs as start and end in bytes).

    Null text counts as empty, and comes back as null text. Texts of fewer bytes lose nothing. Matches
    don't cross documents; repeated rows are copies of each other and so lose all that is long enough. An
    empty table gives no rows. Columns of docs can have any names, since they stay in their struct.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "substrings")
    chunks = f"{folder}/chunks"
    source = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("rest"))

    bounded_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().taskAttemptId() << CHUNK_BITS, None
        last = number + (1 << CHUNK_BITS)
        for batch in batches:
            for part in _parts(batch):
                if chunk is None:
                    if number == last:
                        raise ValueError(f"a task's texts are more than {1 << CHUNK_BITS} chunks: read them in smaller splits")
                    chunk, number = _Chunk(chunks, number, part.schema), number + 1
                yield from chunk.add(part, length)
                if chunk.bytes >= CHUNK_BYTES or chunk.docs >= CHUNK_DOCS - PART_ROWS:
                    yield chunk.close()
                    chunk = None
        if chunk is not None:
            yield chunk.close()
        release_memory()

    # h: anchor; t: hash of the segment's text; at: first window and number of windows.
    rows, _ = stage(source.mapInArrow(cut, "h long, t long, doc long, at long"), "segments")
    seg = rows.where(F.col("h").isNotNull())
    met = seg.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # Staged, so that the join deals both sides anew and Spark can split a frequent anchor's rows.
    met, path = stage(met, "anchors-met")
    again, _ = stage(seg.join(met, "h"), "segments-again")
    drop(spark, path)
    chunk = F.shiftrightunsigned("doc", DOC_BITS).cast("long")

    distinct = again.groupBy("h", "t").agg(F.count("*").alias("n"), F.first("doc").alias("doc"), F.first("at").alias("at"))
    fetched = distinct.withColumn("chunk", chunk).groupBy("chunk").applyInPandas(_fetcher(chunks, length), "h long, t long, n long, body binary")
    texts, path = stage(fetched, "segment-texts")
    # At most one row for HOT rows of texts.
    hot, _ = stage(texts.groupBy("h").agg(F.count("*").alias("texts")).where(F.col("texts") > HOT).select("h"), "anchors-hot")
    known = sized_broadcast(hot, BROADCAST_ROWS)
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bins = max(1, -(-size // BIN_BYTES))
    tasks = max(-(-bins // TASK_BINS), min(bins, 4 * spark.sparkContext.defaultParallelism))
    few = texts.join(known, "h", "left_anti").withColumn("bin", F.pmod(F.xxhash64("h"), F.lit(bins)))
    marks = few.repartition(tasks, "bin").groupBy("bin").applyInPandas(_bin_marker(length), "h long, t long, i long, j long")
    if not hot.isEmpty():
        marks = marks.unionByName(_count_windows(texts.join(known, "h", "left_semi"), length))
    marks, _ = stage(marks, "segment-marks")
    drop(spark, path)
    found = again.join(marks, ["h", "t"]).select("doc", "at", "i", "j")

    first = F.shiftright("at", 16)
    spans = found.select(chunk.alias("chunk"), "doc", (first + F.col("i")).alias("a"), (first + F.col("j") + (length - 1)).alias("b"))
    every = rows.where(F.col("h").isNull()).select(chunk.alias("chunk"))
    # Partitions by the number of chunks: later stages that read what comes of it have as many files.
    many = every.count()
    tasks = max(1, -(-many // TASK_BINS), min(many, 4 * spark.sparkContext.defaultParallelism))
    kept = every.repartition(tasks, "chunk").groupBy("chunk").cogroup(spans.repartition(tasks, "chunk").groupBy("chunk"))
    rest = source.schema["rest"].dataType
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rest.fields)
    schema = f"rest struct<{fields}>, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"
    return kept.applyInArrow(_cutter(chunks, schema, rest), schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BATCH_BYTES of text."""
    sizes = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column("text").cast(pa.binary())])
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = min(at + PART_ROWS, max(at + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def _fetcher(chunks: str, length: int):
    def fetch(want: pd.DataFrame) -> pd.DataFrame:
        want = want.sort_values("doc")
        number = (want["doc"] & ((1 << DOC_BITS) - 1)).to_numpy()
        at, out = want["at"].to_numpy(), []
        lo = np.searchsorted(number, np.arange(number[-1] + 2))
        for n, data, _, _ in _documents(chunks, int(want["chunk"].iloc[0])):
            if n > number[-1]:
                break
            out += [data[s : s + c + length - 1] for s, c in ((int(x) >> 16, int(x) & 0xFFFF) for x in at[lo[n] : lo[n + 1]])]
        release_memory()
        return pd.DataFrame({"h": want["h"], "t": want["t"], "n": want["n"], "body": out})

    return fetch


def _bin_marker(length: int):
    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        bodies, counts, out = rows["body"].tolist(), rows["n"].tolist(), []
        for h, t, starts in zip(rows["h"].tolist(), rows["t"].tolist(), mark_bin(bodies, length, counts), strict=True):
            out += [(h, t, i, j) for i, j in runs(starts)]
        release_memory()
        return pd.DataFrame(out, columns=["h", "t", "i", "j"])

    return mark


def _count_windows(texts: DataFrame, length: int) -> DataFrame:
    """Marks of segments of hot anchors: windows by hash, counted in two steps."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, t, n, body in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                w = window_hashes(np.frombuffer(body, np.uint8), length)
                k = len(w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, h)), pa.array(np.full(k, t)), pa.array(np.full(k, n)), pa.array(np.arange(k)), pa.array(w.view(np.int64))], names=["h", "t", "n", "i", "w"])

    # Dealt by segment, so that one anchor's segments are many tasks'; staged, so that windows are hashed once.
    dealt = texts.select("h", "t", "n", "body").repartition(max(1, texts.sparkSession.sparkContext.defaultParallelism), "h", "t")
    windows, _ = stage(dealt.mapInArrow(explode, "h long, t long, n long, i long, w long"), "segment-windows")
    often, _ = stage(windows.groupBy("h", "w").agg(F.sum("n").alias("times")).where("times > 1").select("h", "w"), "windows-often")
    return windows.join(often, ["h", "w"]).select("h", "t", "i", (F.col("i") + 1).alias("j"))


def window_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of each window of a uint8 array: of the hashes of its 8-byte words and of the bytes left over."""
    n = len(a) - length + 1
    x = np.ndarray((len(a) - 7,), "<u8", np.ascontiguousarray(a), strides=(1,)).copy()
    x = mix64(x, 50)
    h = np.full(n, length, np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, length - 7, 8), length - 8]:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[at : at + n]
    return mix64(h, 51)


def _cutter(chunks: str, schema: str, rest):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [("rest", to_arrow_type(rest)), ("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]

    def cut(key: tuple, every: pa.Table, spans: pa.Table) -> pa.Table:
        if not every.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds})
        number = np.asarray(spans["doc"]) & ((1 << DOC_BITS) - 1)
        order = np.lexsort((np.asarray(spans["a"]), number))
        number, a, b = number[order], np.asarray(spans["a"])[order], np.asarray(spans["b"])[order]
        out = {k: [] for k, _ in kinds[1:]}
        rests = []
        for batch in _read_chunk(chunks, int(every["chunk"][0].as_py())):
            rests.append(batch.column("rest"))
        for n, data, batch, i in _documents(chunks, int(every["chunk"][0].as_py())):
            lo, hi = np.searchsorted(number, [n, n + 1])
            gone = _union(a[lo:hi], b[lo:hi])
            left, at = [], 0
            for x, y in gone:
                left.append(data[at:x])
                at = y
            left.append(data[at:])
            kept = b"".join(left)
            text = kept.decode("utf-8", "ignore") if batch.column("text")[i].is_valid else None
            for k, v in zip(out, (text, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"a": x, "b": y} for x, y in gone]), strict=True):
                out[k].append(v)
        release_memory()
        return pa.table([pa.chunked_array(rests).cast(kinds[0][1]), *(pa.array(out[k], t) for k, t in kinds[1:])], names=[k for k, _ in kinds])

    return cut


def _union(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals sorted by start; those that touch become one."""
    if not len(a):
        return []
    end = np.maximum.accumulate(b)
    cut = np.flatnonzero(a[1:] > end[:-1])
    return list(zip(a[np.r_[0, cut + 1]].tolist(), end[np.r_[cut, len(a) - 1]].tolist(), strict=True))


def digest(found: DataFrame) -> DataFrame:
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
