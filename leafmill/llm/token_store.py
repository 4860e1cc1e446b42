"""Token ids as binary shards with a minimal perfect hash index.

Shard: 16 bytes of magic, version and id width; the raw ids of its documents in ascending key
order; the keys and lengths of its documents; a footer of 32 bytes. Shards ascend too.

Index: keys are dealt into buckets by hash. A bucket holds a minimal perfect hash (levels of bit
arrays: a key sits at the first level where it met no other key, its slot is the number of bits
before it) and, by slot, the key's fingerprint, shard, first id there, ids and records. A look-up
reads one bucket, one slot and one run of a shard, however large the store is; a key that was
never filed is turned away by its fingerprint.

A shard ends when it is full, and the records of one key, however many, may go on in the next ones: the slot then
tells where in the bucket's list of further runs they are.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_KEY, bounded_batches, drop, file_system, mix64, put, stage, workspace
from .encoding import encoder

MAGIC = b"LMTOKENS"
HEAD = struct.Struct("<8sII")
FOOT = struct.Struct("<QQQ8s")
#: Keys in a bucket of the index, about.
BUCKET_KEYS = 50_000
#: Bits for each key that is left at a level.
GAMMA = 2.0
LEVELS = 40
#: Bytes of ids, and documents, with which a shard is full.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 19
#: Shards are numbered within a range partition; its number stands above these bits.
SHARD_BITS = 24
#: Bytes of text that a range partition sorts, about; there are as many as the session's shuffle partitions at least.
TASK_BYTES = 256 << 20
#: Ids that are read from a shard at once, at most, unless one key has more.
READ_IDS = 1 << 22


# -- minimal perfect hash -------------------------------------------------------------------


def build_mph(keys: np.ndarray) -> bytes:
    """Bit levels over distinct int64 keys, as bytes."""
    left, levels = keys.astype(np.int64).view(np.uint64), []
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, int(GAMMA * len(left)))
        at = mix64(left, len(levels)) % np.uint64(size)
        hits = np.bincount(at.astype(np.int64), minlength=size)
        levels.append(np.packbits(hits == 1, bitorder="little"))
        left = left[hits[at.astype(np.int64)] > 1]
    out = io.BytesIO()
    out.write(struct.pack("<I", len(levels)))
    for bits in levels:
        out.write(struct.pack("<Q", len(bits)))
        out.write(bits.tobytes())
    return out.getvalue()


class Mph:
    def __init__(self, blob: bytes):
        self.levels, at, before = [], 4, 0
        for _ in range(struct.unpack_from("<I", blob)[0]):
            n = struct.unpack_from("<Q", blob, at)[0]
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, n, at + 8), bitorder="little")
            rank = np.cumsum(bits, dtype=np.int64) - bits + before
            before += int(bits.sum())
            self.levels.append((bits, rank))
            at += 8 + n
        self.size = before

    def slots(self, keys: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Slot of each key; -1 if no level has it. sizes: the levels' sizes in bits."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        k = keys.astype(np.int64).view(np.uint64)
        for i, ((bits, rank), size) in enumerate(zip(self.levels, sizes, strict=True)):
            at = (mix64(k[left], i) % np.uint64(size)).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def level_sizes(n: int, blob: bytes) -> list[int]:
    """Sizes in bits of the levels: they follow from how many keys each level left over."""
    sizes, at = [], 4
    for _ in range(struct.unpack_from("<I", blob)[0]):
        sizes.append(max(64, int(GAMMA * n)))
        m = struct.unpack_from("<Q", blob, at)[0]
        n -= int(np.unpackbits(np.frombuffer(blob, np.uint8, m, at + 8)).sum())
        at += 8 + m
    return sizes


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64), 1 << 21) % np.uint64(buckets)).astype(np.int64)


# -- shards ---------------------------------------------------------------------------------


class ShardWriter:
    """Writes under a name of its own and renames at the end: a task that runs twice leaves one shard."""

    def __init__(self, folder: str, shard: int, width: int, most_docs: int = SHARD_DOCS):
        self.most_docs = most_docs
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.width, self.shard = f"{base}/shard-{shard:016d}.bin", width, shard
        self.tmp = f"{base}/.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.out.write(HEAD.pack(MAGIC, 1, width))
        self.keys, self.sizes, self.ids = [], [], 0

    def add(self, key: int, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.ids += len(ids)

    @property
    def full(self) -> bool:
        return self.ids * self.width >= SHARD_BYTES or len(self.keys) >= self.most_docs

    def close(self) -> None:
        self.out.write(np.array(self.keys, "<i8").tobytes())
        self.out.write(np.array(self.sizes, "<i8").tobytes())
        self.out.write(FOOT.pack(len(self.keys), self.ids, self.width, MAGIC))
        self.out.close()
        put(self.fs, self.tmp, self.final)


class Shard:
    """Reads a shard: documents(), or ids(start, n) of one document."""

    def __init__(self, folder: str, shard: int):
        fs, base = file_system(folder)
        self.f = fs.open_input_file(f"{base}/shard-{shard:016d}.bin")
        size = self.f.size()
        self.docs, self.n_ids, self.width, magic = FOOT.unpack(self.f.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or self.f.read_at(8, 0) != MAGIC:
            raise ValueError(f"shard {shard} is damaged")
        self.kind = "<u2" if self.width == 2 else "<u4"

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        at = HEAD.size + self.width * self.n_ids
        both = np.frombuffer(self.f.read_at(16 * self.docs, at), "<i8")
        return both[: self.docs], both[self.docs :]

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.f.read_at(self.width * n, HEAD.size + self.width * start), self.kind)


# -- store ----------------------------------------------------------------------------------


class TokenStore:
    """A folder of shards and its index (a Parquet table of buckets).

    null_ids: ids of the records without a key; they come first.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, null_ids: int = 0):
        self.spark, self.folder, self.buckets, self.null_ids = spark, folder, buckets, null_ids

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    @property
    def bases(self) -> DataFrame:
        """Ids of all shards before each shard. One task sums a row for each shard (64 MB of ids), and nothing else."""
        totals = self.spark.read.parquet(f"{self.folder}/shards")
        return totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys: one column ``key``, distinct. Rows key, shard, first, ids, records of those filed: one for each shard."""
        buckets = self.buckets
        with_bucket = keys.select("key").mapInPandas(lambda parts: (pd.DataFrame({"key": p["key"], "bucket": bucket_of(p["key"].to_numpy(), buckets)}) for p in parts), "key long, bucket long")
        return with_bucket.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(_look_up, "key long, shard long, first long, ids long, records long")

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each record filed under a key, in constant time; [] if there is none."""
        rows = self.index.where(F.col("bucket") == int(bucket_of(np.array([key]), self.buckets)[0])).toPandas()
        found = _look_up(pd.DataFrame({"key": [key]}), rows)
        out = []
        for r in found.itertuples():
            shard = Shard(f"{self.folder}/ids", r.shard)
            ids, at = shard.ids(r.first, r.ids), 0
            names, sizes = shard.documents()
            for n in sizes[names == key]:
                out.append(ids[at : at + n])
                at += n
        return out

    def read(self, keys: DataFrame) -> DataFrame:
        """Records of ``keys`` (column ``key``, distinct): key, start (ids of all records before it),
        n_tokens, ids_crc32. The index gives each key's place; each shard's places are then read in
        their order by one task, so a scan of all keys reads the shards from end to end."""
        folder = f"{self.folder}/ids"

        def read_shard(found: pd.DataFrame) -> pd.DataFrame:
            shard, rows = Shard(folder, int(found["shard"].iloc[0])), []
            names, sizes = shard.documents()
            found = found.sort_values("first", ignore_index=True)
            for part in _stretches(found["first"].to_numpy(), found["ids"].to_numpy()):
                begin, read = int(found["first"].iloc[part.start]), int(found["ids"].iloc[part].sum())
                ids = shard.ids(begin, read).astype("<u4")
                for r in found.iloc[part].itertuples():
                    at, lo = r.first, int(np.searchsorted(names, r.key))
                    for n in sizes[lo : lo + r.records].tolist():
                        rows.append((r.shard, r.key, at, n, zlib.crc32(ids[at - begin : at - begin + n].tobytes())))
                        at += n
            return pd.DataFrame(rows, columns=["shard", "key", "at", "n_tokens", "ids_crc32"])

        places = self.lookup(keys).groupBy("shard").applyInPandas(read_shard, "shard long, key long, at long, n_tokens long, ids_crc32 long")
        return places.join(self.bases, "shard").select("key", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def _stretches(first: np.ndarray, ids: np.ndarray) -> Iterator[slice]:
    """Places in order as stretches that follow each other in the file, each of READ_IDS or one place at most: one read each."""
    i = 0
    while i < len(first):
        j = i + 1
        while j < len(first) and first[j] == first[j - 1] + ids[j - 1] and first[j] + ids[j] - first[i] <= READ_IDS:
            j += 1
        yield slice(i, j)
        i = j


def _look_up(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    names = ["shard", "first", "ids", "records"]
    if not len(index) or not len(keys):
        return pd.DataFrame({k: pd.Series([], dtype="int64") for k in ["key", *names]})
    blob, slots = index["mph"].iloc[0], np.frombuffer(index["slots"].iloc[0], "<i8").reshape(7, -1)
    more = np.frombuffer(index["more"].iloc[0], "<i8").reshape(4, -1)
    k = keys["key"].to_numpy()
    at = Mph(blob).slots(k, level_sizes(slots.shape[1], blob))
    good = at >= 0
    good[good] = slots[0][at[good]] == fingerprints(k[good])
    k, found = k[good], slots[:, at[good]]
    begin, n = found[5], found[6]
    further = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = pd.DataFrame({"key": np.r_[k, np.repeat(k, n)]} | {name: np.r_[found[i + 1], more[i][further]] for i, name in enumerate(names)})
    return out.sort_values(["key", "shard"], ignore_index=True)


def _index_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """rows: bucket, key, shard, first, ids, records; a key's rows are its runs, one in a shard."""
    rows = rows.sort_values(["key", "shard"], ignore_index=True)
    key = rows["key"].to_numpy()
    runs = rows[["shard", "first", "ids", "records"]].to_numpy("<i8").T
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    keys, n = key[head], np.diff(np.r_[head, len(key)]) - 1
    blob = build_mph(keys)
    at = Mph(blob).slots(keys, level_sizes(len(keys), blob))
    slots = np.zeros((7, len(keys)), "<i8")
    for i, col in enumerate([fingerprints(keys), *runs[:, head], np.cumsum(n) - n, n]):
        slots[i, at] = col
    more = np.delete(runs, head, axis=1)
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "mph": [blob], "slots": [slots.tobytes()], "more": [np.ascontiguousarray(more).tobytes()]})


def write_token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, shards: int | None = None, shard_docs: int = SHARD_DOCS) -> TokenStore:
    """Encode every whole text and write the store in ascending doc_id order.

    docs: needs doc_id and text; other columns are not read. Null or empty text: the end id alone.
    Records with a null doc_id come first, filed under the reserved key -2**63 (before those of a document of that id).
    Records of one doc_id follow each other by a hash of their text, over as many shards as they fill: they are dealt to
    tasks by that hash too, so one id with very many rows is no task's alone. An empty table gives a store
    without shards. Ids take two bytes where the vocabulary allows it, else four.

    One range shuffle of the texts (by key, so shards ascend); ids go from the encoder straight to
    the shard's file. shards: number of range partitions (default: by bytes of text, at least the session's shuffle
    partitions). shard_docs: documents of a full shard. The rows must come the same when a task runs again, as they do from files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or workspace(spark, "tokens")
    filled = F.col("doc_id").isNotNull()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), filled.alias("filled"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    order = ["key", "filled", "salt", "row"]
    salted = rows.withColumn("salt", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "filled", "text")
    ids_folder = f"{folder}/ids"

    def ended(writer: ShardWriter, filled: list[bool]) -> Iterator[pa.RecordBatch]:
        writer.close()
        firsts = np.cumsum(writer.sizes) - writer.sizes
        for i in range(0, len(writer.keys), 50_000):
            part = slice(i, i + 50_000)
            cols = [pa.array(np.full(len(writer.keys[part]), writer.shard)), pa.array(writer.keys[part], pa.int64()), pa.array(filled[part]), pa.array(firsts[part].astype(np.int64)), pa.array(writer.sizes[part], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "key", "filled", "first", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, writer, flags = encoder(tokenizer), TaskContext.get().partitionId() << SHARD_BITS, None, []
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for key, has, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if writer is None:
                    writer, shard, flags = ShardWriter(ids_folder, shard, width, shard_docs), shard + 1, []
                writer.add(key, np.append(np.frombuffer(enc.encode(text.as_py()), "<u4"), np.uint32(end_id)))
                flags.append(has)
                if writer.full:
                    yield from ended(writer, flags)
                    writer = None
        if writer is not None:
            yield from ended(writer, flags)

    records, path = stage(ordered.mapInArrow(run, "shard long, key long, filled boolean, first long, ids long"), "token-records")
    records.groupBy("shard").agg(F.sum("ids").alias("ids")).write.parquet(f"{folder}/shards")
    places = records.groupBy("key", "shard").agg(F.min("first").alias("first"), F.sum("ids").alias("ids"), F.count("*").alias("records"))
    known = records.agg(F.count("*").alias("n"), F.sum(F.when(~F.col("filled"), F.col("ids"))).alias("null_ids")).first()
    buckets = max(1, -(-known.n // BUCKET_KEYS))
    dealt = places.mapInPandas(lambda parts: (p.assign(bucket=bucket_of(p["key"].to_numpy(), buckets)) for p in parts), "key long, shard long, first long, ids long, records long, bucket long")
    dealt.groupBy("bucket").applyInPandas(_index_bucket, "bucket long, mph binary, slots binary, more binary").write.parquet(f"{folder}/index")
    drop(spark, path)
    return TokenStore(spark, folder, buckets, known.null_ids or 0)


def read_documents(store: TokenStore, docs: DataFrame) -> DataFrame:
    """All records of the store that ``docs`` names: doc_id, start, n_tokens, ids_crc32."""
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    none = (F.col("key") == NULL_KEY) & (F.col("start") < store.null_ids)
    return store.read(keys).select(F.when(~none, F.col("key")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
