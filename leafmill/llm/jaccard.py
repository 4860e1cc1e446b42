"""N-gram Jaccard join with filters under several global token orders.

If two sets have a Jaccard similarity of 0.75 or more, then under any total order of all tokens their
prefixes (the first n - ceil(0.75 n) + 1 tokens of each) share a token. So:

1. One pass counts all shingles of the corpus in a sketch of fixed size (each count is an upper
   bound). The first order puts rare shingles first: frequent lines and passages fall out of prefixes.
2. Prefix tokens under it are dealt out by hash, into as many buckets as their bytes ask for. Sets that meet
   at a token, and whose sizes and places there allow a link, form a group under the least of them; equal groups
   of different tokens fall together.
3. The groups are met with the filters of two more orders before any text moves: of the sets in groups, prefix
   tokens under the next order are dealt out by group and token, and sets that meet there too form the new groups.
4. Texts of what is left are fetched (a Bloom filter of fixed size keeps the others out of the shuffle). In a group,
   pairs must share prefix tokens under every order, and their parity signatures must not differ in more bits than
   linked sets can. What is left is verified on the whole sets. A pair that is connected already is not looked at, so
   a group of near copies gives a tree of links, not all pairs.
5. Components of these links are those of all links: a pair is passed over only if it can't link or
   is connected.

Documents with one set are one node from the first pass on. A group of more than BLOCK sets, or of long ones, is dealt
into blocks at random; afterwards only sets outside the group's largest component meet the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, mix64, release_memory, sized_broadcast, stage
from .components import components
from .words import SPACED, grams, word_hashes

WORDS = 5
NUM, DEN = 75, 100
#: Counters of the frequency sketch: fixed, whatever the corpus, so it is broadcast (a byte each).
SKETCH = 1 << 22
PART = 1 << 16
#: Orders besides the first one.
ORDERS = (1, 2)
#: Sets that are compared in one task at once, and shingles that they have together (hashes and text: some 20 bytes each), about.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22
#: Hashes that a task of the first pass holds before it counts them.
HELD_HASHES = 1 << 21
#: Sizes and places from here on are not told apart in postings.
LARGE = 65535
#: Sets that meet at a token are tried pair by pair, by place and size, up to so many of them.
TRIED = 64
#: Postings (16 bytes each) of a bucket, about: what one group of rows holds in memory, whatever the corpus.
BUCKET_POSTINGS = 1 << 18
#: Buckets that one task works off, about.
TASK_BUCKETS = 16
#: Rows of groups that are split at once, about.
SPLIT_ROWS = 1 << 13
#: Rows of the table of large groups (16 bytes each) up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bits of the Bloom filter over the documents whose texts are wanted: fixed, so it is broadcast.
BLOOM_BITS = 1 << 25


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = word_hashes(text, SPACED)
    if not len(words):
        return words
    h = grams(words, min(WORDS, len(words)))
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def node_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = np.array([mix64(s, 3).sum(dtype=np.uint64) ^ np.uint64(len(s)), np.bitwise_xor.reduce(mix64(s, 4))], np.uint64)
        return int(mix64(x[:1] * np.uint64(0xD1342543DE82EF95) + x[1:], 5).view(np.int64)[0])


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def linked(x: int, y: int, both: int) -> bool:
    return DEN * both >= NUM * (x + y - both)


# -- passes over documents ------------------------------------------------------------------


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1), strict=True)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n, node) for each document, and at the end the task's counts in parts. A task counts to
    255: counts order the tokens, and a token that is so frequent in one task comes late anyway."""
    counts, held, hashes = np.zeros(SKETCH, np.uint32), [], 0
    rows: list[tuple] = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, ns, nodes, parts, blobs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "node", "part", "counts"])

    def count() -> None:
        np.add.at(counts, np.concatenate(held), np.uint32(1))
        held.clear()

    for doc, text in _texts(batches):
        s = shingles(text.as_py())
        held.append((s & np.uint64(SKETCH - 1)).astype(np.int64))
        hashes += len(s)
        rows.append((doc, len(s), node_of(s) if len(s) else None, None, None))
        if hashes >= HELD_HASHES or len(held) >= 2000:
            count()
            hashes = 0
        if len(rows) >= 20_000:
            yield batch(rows)
            rows = []
    if held:
        count()
    if rows:
        yield batch(rows)
    for i in range(0, SKETCH, PART):
        if counts[i : i + PART].any():
            yield batch([(None, None, None, i // PART, zstandard.compress(np.minimum(counts[i : i + PART], 255).astype(np.uint8).tobytes(), 1))])
    del counts
    release_memory()


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART, np.uint64)
    for b in rows["counts"]:
        raw = zstandard.decompress(b)
        total += np.frombuffer(raw, np.uint8 if len(raw) == PART else np.uint64)
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [zstandard.compress(total.tobytes(), 1)]})


def _levels(rows: pd.DataFrame) -> pd.DataFrame:
    """A part's summed counts as quarters of powers of two, a byte each."""
    c = np.frombuffer(zstandard.decompress(_add_counts(rows)["counts"].iloc[0]), np.uint64)
    levels = np.minimum(4 * np.log2(np.maximum(c, 1).astype(np.float64)), 255).astype(np.uint8)
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "levels": [levels.tobytes()]})


def _sketch(rows: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts, as quarters of powers of two; SKETCH bytes, however large the corpus is."""
    salted = rows.where(F.col("part").isNotNull()).select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(256)).alias("salt"))
    some = salted.groupBy("part", "salt").applyInPandas(_add_counts, "part long, counts binary")
    out = np.zeros(SKETCH, np.uint8)
    # One job, of which SKETCH bytes come to the driver: a job for each partition would grow with the cluster.
    for r in some.groupBy("part").applyInPandas(_levels, "part long, levels binary").collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.levels, np.uint8)
    return out


class _Blobs:
    """Postings on their way out, gathered by bucket: token, node, size and place as bytes."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.parts = buckets, 0, []

    def add(self, tokens: np.ndarray, node: int, size: int) -> Iterator[pa.RecordBatch]:
        """Postings of a set whose prefix tokens come in their order."""
        k = len(tokens)
        self.parts.append((tokens, np.full(k, node), np.full(k, min(size, LARGE)), np.minimum(np.arange(k), LARGE)))
        self.held += k
        if self.held >= 400_000:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        t, n, z, p = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        bucket = ((t >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        t, n, z, p, bucket = t[order], n[order], z[order], p[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cut[1:], len(t)]
        blob = [t[i:j].astype("<u4").tobytes() + n[i:j].astype("<i8").tobytes() + z[i:j].astype("<u2").tobytes() + p[i:j].astype("<u2").tobytes() for i, j in zip(cut, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blob, pa.binary())], names=["bucket", "rows"])


def _buckets(sizes: DataFrame) -> int:
    """How many buckets the postings of sets (n: their sizes) fill."""
    total = sizes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).first()[0] or 0
    return int(max(1, -(-total // BUCKET_POSTINGS)))


def _by_bucket(rows: DataFrame, buckets: int):
    """Rows grouped by bucket, TASK_BUCKETS of them to a task: what a task reads doesn't grow with the corpus."""
    tasks = max(-(-buckets // TASK_BUCKETS), min(buckets, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks, "bucket").groupBy("bucket")


def _postings(levels, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, out = levels.value, set(), _Blobs(buckets)
        for _, text in _texts(batches):
            s = shingles(text.as_py())
            if not len(s):
                continue
            node = node_of(s)
            if node in seen:  # copies of one set within the task
                continue
            if len(seen) < 1_000_000:
                seen.add(node)
            order = np.lexsort((s, sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[: prefix_size(len(s))]
            # The low bits place a token in the sketch; another mix deals it out.
            yield from out.add(mix64(s[order], 6), node, len(s))
        if out.held:
            yield out.flush()
        del seen
        release_memory()

    return run


def in_order(s: np.ndarray, order: int) -> np.ndarray:
    """Prefix of a set under one of the further orders, in that order (tokens mixed for it)."""
    mixed, k = mix64(s, 10 + order), prefix_size(len(s))
    return np.sort(np.partition(mixed, k - 1)[:k])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n and the prefixes under the further orders of each document's set (rows: key, text)."""
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            s = shingles(text)
            if len(s):
                rows.append((node_of(s), len(s), *((in_order(s, o) >> np.uint64(32)).astype("<u4").tobytes() for o in ORDERS)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["node", "n", "p1", "p2"])
    release_memory()


def _dealt_again(buckets: int, order: int):
    """Postings of groups' sets by group and token. rows: a, node, n, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Blobs(buckets)
        for b in batches:
            for a, node, n, tokens in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                t = np.frombuffer(tokens, "<u4").astype(np.uint64) ^ mix64(np.array([a], np.int64).view(np.uint64), 20 + order)
                yield from out.add(mix64(t, 30), node, n)
        if out.held:
            yield out.flush()
        release_memory()

    return run


def _groups(rows: pd.DataFrame) -> pd.DataFrame:
    """Sets that meet at a token, under the least of them. rows: postings of a bucket.

    Of two sets whose first common token this is, no token before its place is shared: what is left of the shorter rest
    must make up the overlap. Pairs that fail this here share an earlier token, where they are tried again."""
    blobs = rows["rows"].tolist()
    ks = [len(b) // 16 for b in blobs]
    t, n, z, p = (np.concatenate([np.frombuffer(b, kind, k, off * k) for b, k in zip(blobs, ks, strict=True)]) for kind, off in (("<u4", 0), ("<i8", 4), ("<u2", 12), ("<u2", 14)))
    z, p = z.astype(np.int64), p.astype(np.int64)
    order = np.lexsort((n, z, t))
    t, n, z, p = t[order], n[order], z[order], p[order]
    keep = np.r_[True, (t[1:] != t[:-1]) | (n[1:] != n[:-1])]
    t, n, z, p = t[keep], n[keep], z[keep], p[keep]
    # Sizes ascend within a token: where two neighbours can't link, none across them can.
    far = (DEN * z[:-1] < NUM * z[1:]) & (z[1:] < LARGE)
    start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | far])
    size = np.diff(np.r_[start, len(t)])
    out = []
    for g in np.unique(size[size > 1]).tolist():
        at = start[size == g][:, None] + np.arange(g)
        if g > TRIED:
            good = np.ones(at.shape, bool)
        else:
            zz, rest = z[at], np.where(z[at] < LARGE, z[at] - p[at], 1 << 30)
            good = np.zeros(at.shape, bool)
            for k in range(1, g):  # each set with that k places on
                pair = np.minimum(rest[:, :-k], rest[:, k:]) * (DEN + NUM) >= NUM * (zz[:, :-k] + zz[:, k:])
                good[:, :-k] |= pair
                good[:, k:] |= pair
        least = np.where(good, n[at], np.iinfo(np.int64).max).min(axis=1)
        out.append(pd.DataFrame({"a": np.repeat(least, g)[good.ravel()], "node": n[at].ravel()[good.ravel()]}))
    release_memory()
    return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": pd.Series([], dtype="int64"), "node": pd.Series([], dtype="int64")})


# -- groups ---------------------------------------------------------------------------------


class Sets:
    """Token sets with what the filters need, made once for each set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        bits = max(6, int(2 * self.sizes.max() - 1).bit_length())
        self.bits = min(bits, 14)
        self.signs = np.stack([np.packbits(np.bincount((s >> np.uint64(20) & np.uint64((1 << self.bits) - 1)).astype(np.int64), minlength=1 << self.bits).astype(np.uint8) & 1) for s in sets]).view(np.uint64)
        self.prefixes: dict[tuple[int, int], np.ndarray] = {}

    def prefix(self, i: int, order: int) -> np.ndarray:
        if (i, order) not in self.prefixes:
            self.prefixes[i, order] = in_order(self.sets[i], order)
        return self.prefixes[i, order]

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose size and signature allow a link with set i."""
        a, b = self.sizes[i], self.sizes[others]
        others = others[DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)]
        # Sets that differ in d tokens have signatures that differ in d bits at most.
        differ = np.bitwise_count(self.signs[others] ^ self.signs[i]).sum(axis=1, dtype=np.int64)
        return others[(DEN + NUM) * differ <= (DEN - NUM) * (a + self.sizes[others])]

    def link(self, i: int, j: int) -> bool:
        if any(not _meet(self.prefix(i, o), self.prefix(j, o)) for o in ORDERS):
            return False
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        return linked(len(a), len(b), int((b[np.minimum(at, len(b) - 1)] == a).sum()))


def _meet(a: np.ndarray, b: np.ndarray) -> bool:
    at = np.searchsorted(b, a)
    return bool((b[np.minimum(at, len(b) - 1)] == a).any())


def forest(sets: Sets, left: np.ndarray, right: np.ndarray, root: list[int]) -> list[tuple[int, int]]:
    """Links that connect all that links between ``left`` and ``right`` connect, given that sets of one
    root are connected. Sets are numbers; left and right may overlap."""
    parent = list(range(len(root)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    for i, r in enumerate(root):
        parent[i] = seen.setdefault(r, i)
    out = []
    same = np.array_equal(left, right)
    for k, i in enumerate(left.tolist()):
        for j in sets.may_link(i, right[k + 1 :] if same else right).tolist():
            a, b = find(i), find(j)
            if a != b and sets.link(i, j):
                parent[a] = b
                out.append((i, j))
    return out


def _link_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a group or block: columns node, text, side (0: both, 1: left, 2: right), root."""
    rows = rows.drop_duplicates(["node", "side"]).reset_index(drop=True)
    sets, keep = [], []
    for k, (node, text) in enumerate(zip(rows["node"], rows["text"], strict=True)):
        s = shingles(text)
        if len(s) and node_of(s) == node:
            sets.append(s)
            keep.append(k)
    rows = rows.iloc[keep]
    if len(rows) < 2:
        return pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64")})
    nodes, side = rows["node"].to_numpy(), rows["side"].to_numpy()
    found = forest(Sets(sets), np.flatnonzero(side != 2), np.flatnonzero(side != 1), rows["root"].tolist())
    return pd.DataFrame([(nodes[i], nodes[j]) for i, j in found], columns=["u", "v"]).astype("int64")


def _node_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and text of each document that has a set."""
    for b in batches:
        rows = [(node_of(s), t) for t in b.column(0).to_pylist() for s in [shingles(t)] if len(s)]
        nodes, texts = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["node", "text"])


def _joined(labels: np.ndarray, row: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Labels of rows (each the least row of its part), split where no shared token joins a part's rows.
    row, token: which rows have which tokens."""
    order = np.lexsort((token, labels[row]))
    row, key_label, token = row[order], labels[row][order], token[order]
    first = np.flatnonzero(np.r_[True, (key_label[1:] != key_label[:-1]) | (token[1:] != token[:-1])])
    size = np.diff(np.r_[first, len(row)])
    now = np.arange(len(labels))
    while True:
        least = np.minimum.reduceat(now[row], first)
        new = now.copy()
        np.minimum.at(new, row, np.repeat(least, size))
        new = new[new]
        if (new == now).all():
            return now
        now = new


def _split(rows: pd.DataFrame) -> pd.DataFrame:
    """Parts of groups whose sets are joined by shared prefix tokens under each further order. rows: a, node, n, p1, p2."""
    _, labels = np.unique(rows["a"].to_numpy(), return_inverse=True)
    for col in ("p1", "p2"):
        count = rows[col].str.len().to_numpy() // 4
        labels = _joined(labels, np.repeat(np.arange(len(rows)), count), np.frombuffer(b"".join(rows[col]), "<u4"))
    kept = np.bincount(labels, minlength=len(rows))[labels] > 1
    # A part is named by its group and its first row's node.
    a, node = rows["a"].to_numpy(), rows["node"].to_numpy()
    name = mix64(a.view(np.uint64), 40) ^ mix64(node[labels].view(np.uint64), 41)
    release_memory()
    return pd.DataFrame({"a": name.view(np.int64)[kept], "node": node[kept]})


def _unnamed(sets: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame | None:
    """node and text of the sets that only documents with a null doc_id have, or None if there are none."""
    only = sets.where(F.col("node").isNotNull() & F.col("doc_id").isNull()).select("node").distinct().join(named, "node", "left_anti")
    only, path = stage(only, "jaccard-unnamed")
    if only.isEmpty():
        drop(docs.sparkSession, path)
        return None
    texts = docs.where(F.col("doc_id").isNull()).select("text").mapInArrow(_node_texts, "node long, text string")
    return stage(texts.join(only, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "jaccard-unnamed-texts")[0]


def bloom(ids: DataFrame) -> np.ndarray:
    """Bloom filter over the column ``rep``, as 64-bit words: BLOOM_BITS, however many ids there are."""
    at = F.explode(F.array(*(F.pmod(F.xxhash64("rep", F.lit(k)), F.lit(BLOOM_BITS)) for k in (1, 2)))).alias("at")
    words = ids.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    # One job, of which 16 bytes a word come to the driver: 8 MB at most, whatever the corpus.
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _of(docs: DataFrame, reps: DataFrame, make=None, schema: str = "rep long, text string") -> DataFrame:
    """rep and text of the documents that ``reps`` (rep) may name: most others are kept out of the shuffle that follows. make:
    a step on these batches, taken in the same Python worker."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(reps))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for b in batches:
            good = np.ones(b.num_rows, bool)
            for i in (2, 3):
                at = b.column(i).to_numpy(zero_copy_only=False)
                good &= (bits[at >> 6] >> (at & 63)) & 1 == 1
            for i in np.flatnonzero(good).tolist():  # a row that is there often leaves the task once
                row = b.column(0)[i].as_py(), b.column(4)[i].as_py()
                good[i] = row not in seen
                if len(seen) < 1_000_000:
                    seen.add(row)
            if good.any():
                yield b.filter(pa.array(good)).select([0, 1])
        del seen
        release_memory()

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text")
    places = (F.pmod(F.xxhash64("rep", F.lit(k)), F.lit(BLOOM_BITS)).alias(f"at{k}") for k in (1, 2))
    run = kept if make is None else lambda batches: make(kept(batches))
    return named.select("rep", "text", *places, F.xxhash64("text").alias("hash")).mapInArrow(run, schema)


def _with_text(rows: DataFrame, named: DataFrame, unnamed: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Add the text of a document that has the node's set. named: node, rep (a doc_id); unnamed: node, text."""
    wanted, _ = stage(rows.join(named, "node"), "jaccard-wanted")
    # Merged at every size: texts and wanted rows both grow with the corpus, and one plan holds from small tables to large ones.
    found = _of(docs, wanted.select("rep").distinct()).join(wanted.hint("merge"), "rep").select(*rows.columns, "text")
    return found if unnamed is None else found.unionByName(rows.join(unnamed, "node").select(*rows.columns, "text"))


def _refine(groups: DataFrame, named: DataFrame, unnamed: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Groups (a, node) met with the filters of the further orders: groups of sets that meet at prefix tokens under
    each of them too. Small ones are split many at a time; those of more than BLOCK sets are dealt out by group and
    token, whatever their size."""
    spark = docs.sparkSession
    wanted, path = stage(groups.select("node").distinct().join(named, "node"), "jaccard-members")
    # Documents that the filter lets pass by chance, or by an id that is there with another text too, have sets in no group: they join with none.
    found = "node long, n long, p1 binary, p2 binary"
    made = _of(docs, wanted.select("rep"), _prefixes, found)
    if unnamed is not None:
        made = made.unionByName(unnamed.select("text").mapInArrow(_prefixes, found))
    prefixes, path2 = stage(made.groupBy("node").agg(F.first("n").alias("n"), F.first("p1").alias("p1"), F.first("p2").alias("p2")), "jaccard-prefixes")
    drop(spark, path)
    # At most one row for BLOCK rows of groups.
    sizes, path = stage(groups.groupBy("a").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "jaccard-sizes")
    large = sized_broadcast(sizes, BROADCAST_ROWS)
    small = groups.join(large, "a", "left_anti").join(prefixes.hint("merge"), "node")
    buckets = max(1, -(-groups.count() // SPLIT_ROWS))
    split = _by_bucket(small.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(buckets))), buckets).applyInPandas(_split, "a long, node long")
    out, _ = stage(split, "jaccard-split")
    if not sizes.isEmpty():
        now = groups.join(large, "a", "left_semi")
        for order in ORDERS:
            posted, new = stage(now.join(prefixes.hint("merge"), "node").select("a", "node", "n", F.col(f"p{order}").alias("tokens")), "jaccard-posted")
            buckets = _buckets(posted)
            met = _by_bucket(posted.mapInArrow(_dealt_again(buckets, order), "bucket long, rows binary"), buckets).applyInPandas(_groups, "a long, node long")
            now, _ = stage(met.distinct(), "jaccard-groups")
            drop(spark, new)
        out, _ = stage(out.unionByName(now), "jaccard-refined")
    drop(spark, path, path2)
    return out


def _links(groups: DataFrame, nodes: DataFrame, named: DataFrame, unnamed: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Links of all groups (a, node); edges u, v. A group of many sets, or of long ones, is dealt into blocks."""
    links = "u long, v long"
    # At most one row for BLOCK rows or BLOCK_SHINGLES shingles of groups.
    sized = groups.join(nodes.select("node", "n").hint("merge"), "node").groupBy("a").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    sizes, _ = stage(sized.select("a", F.least(blocks, F.col("size")).alias("blocks")).where("blocks > 1"), "jaccard-sizes")
    groups = groups.join(sized_broadcast(sizes, BROADCAST_ROWS), "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    block = F.pmod(F.xxhash64("node", "a"), F.col("blocks"))
    rows = groups.select("a", "node", block.alias("b"), F.lit(0).alias("side"), F.col("node").alias("root"))
    edges, _ = stage(_with_text(rows, named, unnamed, docs).groupBy("a", "b").applyInPandas(_link_group, links), "jaccard-links")
    large = groups.where("blocks > 1")
    if large.isEmpty():
        return edges
    # Sets outside the largest component of a large group meet all the others, block by block.
    comps = components(edges).select("node", F.col("component").alias("root"))
    known = large.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = known.groupBy("a", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("a").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("size"))
    known, _ = stage(known.join(main, "a").withColumn("b", block), "jaccard-large")
    rest = known.where("root != main")
    # As many sets of the rest to a block as of the whole.
    rests = rest.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.first("blocks") / F.first("size"))).cast("long").alias("rests"))
    left = rest.join(rests, "a").select("a", "node", "root", F.pmod(F.xxhash64("node", "a", F.lit(1)), F.col("rests")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), F.lit(1).alias("side"))
    right = known.join(rests, "a").select("a", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("r"), "b", F.lit(2).alias("side"))
    more = _with_text(left.unionByName(right), named, unnamed, docs).groupBy("a", "r", "b").applyInPandas(_link_group, links)
    return edges.unionByName(stage(more, "jaccard-links")[0])


def similar_documents(docs: DataFrame) -> DataFrame:
    """Link documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more, exactly.

    docs: needs doc_id and text; other columns are not read. A row for each row: doc_id, n_shingles,
    component_id (the smallest doc_id that links reach). A text of fewer than five words is one shingle;
    null text and a text without words have no shingles and link with nothing, not even each other.
    Repeated rows link with each other (their sets are equal). A null doc_id takes part and is the smallest of
    none: its component is that of the smallest id beside it, else null. An empty table gives no rows.

    Sets are named by 64-bit hashes of 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, _ = stage(docs.mapInArrow(_first_pass, "doc_id long, n long, node long, part long, counts binary"), "jaccard-sets")
    sets = first.where(F.col("n").isNotNull()).select("doc_id", "n", "node")
    levels = spark.sparkContext.broadcast(_sketch(first))
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"))
    nodes, _ = stage(nodes, "jaccard-nodes")
    buckets = _buckets(nodes)
    dealt = docs.mapInArrow(_postings(levels, buckets), "bucket long, rows binary")
    met, path = stage(_by_bucket(dealt, buckets).applyInPandas(_groups, "a long, node long").distinct(), "jaccard-groups")
    named = nodes.where("rep IS NOT NULL").select("node", "rep")
    unnamed = _unnamed(sets, named, docs)
    comps, _ = stage(components(_links(_refine(met, named, unnamed, docs), nodes, named, unnamed, docs)), "jaccard-components")
    drop(spark, path)
    # The least id of each component, by way of nodes. Each table is staged, so that the next join deals both sides anew and
    # Spark can split a frequent key's rows.
    least, _ = stage(nodes.join(comps, "node").groupBy("component").agg(F.min("rep").alias("least")), "jaccard-least")
    found = nodes.join(comps.join(least, "component"), "node", "left")
    found, _ = stage(found.select("node", F.coalesce("least", "rep").alias("least")), "jaccard-found")
    return sets.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.k + ny.k - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
