"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage.

Terms are runs of three words. An item's scores are divided by the least score that a passage can have which
holds three quarters of its shingles, so one threshold, 1, holds for all, and retrieval loses nothing that the
verification would accept. Block-max WAND walks the postings of a passage's terms: lists are ordered by the item
they stand at, the pivot is where the lists' greatest weights first reach the threshold, and the greatest
weights of the blocks there decide whether they are skipped or all of their items scored at once: where items share a template, its
words weigh next to nothing, and a passage that holds it retrieves many.

What it retrieves is verified: shares of the 5-word shingles of the item, of its question and of its answer that
stand in the passage, by counters over an inverted index of shingles, for all items at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, stage
from .words import LETTERS, grams, word_hashes

TERM_WORDS = 3
SHINGLE_WORDS = 5
OVERLAP = 0.75
K1, B = 1.2, 0.75
#: Postings in a block.
BLOCK = 64
#: Words of a passage at least; it is twice the longest item otherwise. Passages overlap by half.
PASSAGE_WORDS = 128
#: Bytes of item texts in one index, which is broadcast; more items make more indexes, one pass for each. An index is flat
#: arrays of about ARRAYS bytes for each byte of text, whatever the items are.
INDEX_BYTES = 6 << 20
ARRAYS = 10

#: Bits of an item's number within a posting.
ITEM_BITS = 32
ITEMS = (1 << ITEM_BITS) - 1

_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*[:.]\s*", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: at a line that begins with "answer:", else the last sentence is the
    answer, and of a single sentence the last quarter of its words."""
    m = None
    for m in _ANSWER.finditer(text):
        pass
    if m and text[: m.start()].strip() and text[m.end() :].strip():
        return text[: m.start()], text[m.end() :]
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _parts(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct runs of ``size`` words; of fewer words, the whole."""
    return np.unique(grams(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _by_id(row: tuple[int | None, str]) -> tuple:
    return row[0] is None, row[0] or 0, row[1]


def _flat(parts: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays in a row, and where each of them begins (and the last ends)."""
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=at[1:])
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(kind), at


class Postings:
    """Postings of all terms in a row, ascending: the term's number above ITEM_BITS bits of the item's, and weights."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, at: np.ndarray):
        self.keys, self.weights, self.at = keys, weights, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[term], self.at[term + 1])
        return self.keys[part] & ITEMS, self.weights[part].astype(np.float64)

    def find(self, terms: np.ndarray, item: int) -> np.ndarray:
        """Place of the first posting of each term that isn't before an item; its list's end if there is none."""
        return np.searchsorted(self.keys, terms << ITEM_BITS | item)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from begin to end of each."""
    n = np.maximum(end - begin, 0)
    return np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Index:
    """Postings of items by term, in blocks with their greatest weights; flat arrays throughout."""

    def __init__(self, rows: list[tuple[int, str]]):
        ids, sizes, shingles, members, terms, weights = [], [], [], [], [], []
        part_sizes: list[tuple[int, int, int]] = []
        shingle_sizes, term_sizes = set(), set()
        counts = []
        for item_id, text in sorted(rows, key=_by_id):
            words = [word_hashes(x, LETTERS) for x in (text, *split_item(text))]
            n = len(words[0])
            if not n:
                continue
            ids.append(item_id)
            sizes.append(n)
            parts = [_parts(w, SHINGLE_WORDS) for w in words]
            shingle_sizes.update(min(SHINGLE_WORDS, len(w)) for w in words)
            every = np.unique(np.concatenate(parts))
            shingles.append(every)
            member = np.zeros(len(every), np.uint8)
            for i, x in enumerate(parts):
                member[np.searchsorted(every, x)] |= 1 << i
            members.append(member)
            part_sizes.append(tuple(map(len, parts)))
            term_sizes.add(min(TERM_WORDS, n))
            t, c = np.unique(grams(words[0], min(TERM_WORDS, n)), return_counts=True)
            terms.append(t)
            counts.append(c.astype(np.int32))
        self.ids, self.term_sizes, self.shingle_sizes = ids, sorted(term_sizes), sorted(shingle_sizes - {0})
        self.sizes = np.array(part_sizes, np.int32).reshape(-1, 3)
        flat, at = _flat(shingles, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.members = flat[order], _flat(members, np.uint8)[0][order]
        self.holders = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(at))[order]
        del flat, order, shingles, members
        lengths, n = np.array(sizes, np.float64), len(ids)
        self.n_items, self.passage = n, max(PASSAGE_WORDS, 2 * max(sizes, default=0))
        flat, at = _flat(terms, np.uint64)
        del terms
        self.terms, which = np.unique(flat, return_inverse=True)
        del flat
        df = np.bincount(which, minlength=len(self.terms)).astype(np.float64)
        rarity = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = float(lengths.mean()) if n else 1.0
        for k in range(n):
            tf = counts[k].astype(np.float64)
            w = rarity[which[at[k] : at[k + 1]]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[k] / mean))
            # A quarter of the shingles of question and answer may be missing, and with them as many terms.
            question, answer = self.sizes[k, 1:].tolist()
            lost = sum(int((1 - OVERLAP) * x) + 1 for x in (question, answer)) if lengths[k] > SHINGLE_WORDS else 0
            bound = np.sort(w)[: max(1, len(w) - lost - (SHINGLE_WORDS - TERM_WORDS))].sum()
            # Rounded up, so that no item loses its score to single precision.
            weights.append(np.nextafter((w / bound).astype(np.float32), np.float32(np.inf)))
        all_weights, _ = _flat(weights, np.float32)
        del weights, counts
        order = np.argsort(which, kind="stable")  # within a term, items ascend
        keys = which[order].astype(np.int64) << ITEM_BITS | np.repeat(np.arange(n), np.diff(at))[order]
        starts = np.zeros(len(self.terms) + 1, np.int64)
        np.cumsum(df.astype(np.int64), out=starts[1:])
        self.postings = Postings(keys, all_weights[order], starts)
        # Blocks begin anew with each term.
        blocks = -(-np.diff(starts) // BLOCK)
        self.block_at = np.zeros(len(self.terms) + 1, np.int64)
        np.cumsum(blocks, out=self.block_at[1:])
        first = np.repeat(starts[:-1], blocks) + BLOCK * (np.arange(self.block_at[-1]) - np.repeat(self.block_at[:-1], blocks))
        self.block_max = np.maximum.reduceat(self.postings.weights, first) if len(first) else np.zeros(0, np.float32)
        self.greatest = np.maximum.reduceat(self.block_max, self.block_at[:-1]).astype(np.float64) if len(first) else np.zeros(0)
        # Most terms of a text are in no list: a table of bits turns them away.
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.terms, self.postings.keys, self.postings.weights, self.postings.at, self.block_at, self.block_max, self.greatest, self.bits, self.shingles, self.members, self.holders, self.sizes))

    def shares(self, items: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Shares of the items' shingles (columns: of the whole, question, answer) that are in a window of distinct ones; of none: 1."""
        at = _ranges(np.searchsorted(self.shingles, window), np.searchsorted(self.shingles, window, "right"))
        who, what = self.holders[at], self.members[at]
        found = np.stack([np.bincount(who[what >> i & 1 == 1], minlength=self.n_items)[items] for i in range(3)], 1)
        of = self.sizes[items]
        return np.where(of > 0, found / np.maximum(of, 1), 1.0)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text and numbers of the terms that stand there, by position."""
        at, which = [], []
        for k in self.term_sizes:
            g = grams(words, k)
            p = np.flatnonzero(self.bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            t = np.searchsorted(self.terms, g[p])
            good = self.terms[np.minimum(t, len(self.terms) - 1)] == g[p]
            at.append(p[good])
            which.append(t[good])
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.argsort(at, kind="stable")
        return at[order], which[order]

    def retrieve(self, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """All items whose score for a query of distinct terms reaches the threshold, by block-max WAND. Where the blocks of a
        pivot can reach it, their items are scored together."""
        slack, post, end = threshold - 1e-9, self.postings, self.n_items
        t = np.asarray(terms, np.int64)
        p = post.at[t]
        out: list[tuple[int, float]] = []
        while True:
            alive = p < post.at[t + 1]
            t, p = t[alive], p[alive]
            stands = post.keys[p] & ITEMS
            order = np.argsort(stands, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(self.greatest[t[order]]), slack))
            if pivot >= len(t):
                return out
            item = int(stands[order[pivot]])
            upto_pivot = order[: np.searchsorted(stands[order], item, "right")]
            # Greatest weights of the blocks in which the item would stand, and where the first of them ends.
            mine = t[upto_pivot]
            at = post.find(mine, item)
            there = at < post.at[mine + 1]
            mine, at = mine[there], at[there]
            block = (at - post.at[mine]) // BLOCK
            last = int((post.keys[np.minimum(post.at[mine] + (block + 1) * BLOCK, post.at[mine + 1]) - 1] & ITEMS).min())
            if float(self.block_max[self.block_at[mine] + block].sum(dtype=np.float64)) < slack:
                # No item up to the end of these blocks (or before the next list's) can reach it.
                following = int(stands[order[len(upto_pivot)]]) if len(upto_pivot) < len(order) else end
                p[upto_pivot] = post.find(t[upto_pivot], max(item + 1, min(last + 1, following)))
                continue
            begin, p = post.find(t, item), post.find(t, last + 1)
            among = _ranges(begin, p)
            which = (post.keys[among] & ITEMS) - item
            score = np.bincount(which, post.weights[among], last + 1 - item)
            good = np.flatnonzero(score >= slack)
            out += zip((good + item).tolist(), score[good].tolist(), strict=True)

    def search(self, text: str | None) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, question, answer, whole) of each item that a passage of a text holds."""
        words = word_hashes(text, LETTERS)
        if not len(words) or not len(self.terms):
            return []
        at, which = self.hits(words)
        step, best = self.passage // 2, {}
        first = at // step
        for k in np.unique(np.maximum(np.r_[first, first - 1], 0)).tolist():
            lo, hi = np.searchsorted(at, [k * step, k * step + self.passage])
            terms = np.unique(which[lo:hi])
            if self.greatest[terms].sum() < 1 - 1e-9:
                continue
            if not (found := self.retrieve(terms.tolist())):
                continue
            window = np.unique(np.concatenate([grams(words[k * step : k * step + self.passage + SHINGLE_WORDS], s) for s in self.shingle_sizes]))
            shares = self.shares(np.array([item for item, _ in found]), window)
            for i in np.flatnonzero((shares[:, 0] >= OVERLAP) | (shares[:, 1:] >= OVERLAP).all(1)).tolist():
                (item, score), (w, q, a) = found[i], shares[i].tolist()
                best[item] = max(best.get(item, (0.0,)), (w, round(score, 6), q, a))
        return [(self.ids[k], s, q, a, w) for k, (w, s, q, a) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
KINDS = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"]


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold a passage of an item (item_id, text): a row for each pair, with BM25 score
    (1 is the least that a match can have) and shares of shingles found.

    A pair counts if three quarters of the item's 5-word shingles stand in one passage, or three quarters of both the
    question's and the answer's. Words are digits, letters and characters beyond ASCII, A-Z lower-cased; parts of fewer
    than five words must stand there whole. Null and empty texts and items without a word match nothing; repeated rows
    are searched one by one; empty tables give no rows. Other columns of both tables are not read.

    The items' index is broadcast: at most INDEX_BYTES of text, as flat arrays of about ARRAYS times as many bytes. Beyond,
    items are dealt into several by a hash of their text, and each is built, broadcast and searched in a pass of its own whose result is
    written; one index is alive at a time, on the driver and in the workers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // INDEX_BYTES))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(doc, *hit) for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for hit in held.value.search(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
            release_memory()

        return run

    def found(shard: int) -> tuple[DataFrame, Broadcast]:
        mine = known if shards == 1 else known.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard)
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in mine.collect()]))
        return source.mapInArrow(search(index), SCHEMA), index

    if shards == 1:
        return found(0)[0]
    out = None
    for shard in range(shards):
        rows, index = found(shard)
        rows, _ = stage(rows, "leaks")
        index.destroy()
        out = rows if out is None else out.unionByName(rows)
    return out
