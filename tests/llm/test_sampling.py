import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import negatives, resampling


def brute_negatives(rows, anchors, scale=256, k=5, lower=80, upper=100):
    """rows: (vec_id, label, vector); every anchor against every row."""
    use = [(i, v, y, [math.floor(scale * float(c)) for c in x]) for i, (v, y, x) in enumerate(rows) if v is not None and y is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, v, y, x in use:
        if not anchors(v):
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, z, strict=False)), w, j, label) for j, w, label, z in use if j != i)
        for s, w, j, label in [r for r in scored if r[3] == y][:k]:
            band = [r for r in scored if r[3] != y and lower * -s <= 100 * -r[0] <= upper * -s][:k]
            out += [(v, w, n, r[1], -s, -r[0]) for n, r in enumerate(band, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(v, y, x, 1, "a") for v, y, x in rows], "vec_id long, label int, embedding array<float>, row int, cell string")


@pytest.mark.parametrize(("kind", "dims"), [("clusters", 3), ("spread", 6), ("copies", 4), ("mixed", 2)])
def test_negatives(spark, monkeypatch, kind, dims):
    rng = random.Random(dims)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(500):
        x = [float(np.float32(c + rng.gauss(0, 0.03 if kind != "spread" else 1))) for c in middle[i % 6]]
        if kind == "copies" and i % 3:
            x = [0.5] * dims
        rows.append((i, rng.randrange(3), x))
    if kind == "mixed":
        nan, inf = float("nan"), float("inf")
        rows += [(1, 0, None), (2, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (3, 0, [nan, 1.0]), (4, 0, [inf, 0.0]), (5, 1, [None, 1.0]), (6, 1, []), (7, 2, [9.0]), (10, 0, [1.0, -1.0, 3.0])]
    rows = [(v, y, x if x is None else [None if c is None else float(np.float32(c)) for c in x]) for v, y, x in rows]
    monkeypatch.setattr(negatives, "GROUP", 8)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 200)
    monkeypatch.setattr(negatives, "HELD_ROWS", 60)
    monkeypatch.setattr(negatives, "HELD_HITS", 40)
    monkeypatch.setattr(negatives, "TASK_BLOCKS", 9)
    found = negatives.hard_negatives(vectors(spark, rows).repartition(3), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda v: v % 10 == 0)


def test_negatives_edges(spark):
    none = vectors(spark, [])
    assert negatives.mine(none).collect() == [] and negatives.mine(vectors(spark, [(1, 1, [1.0]), (2, 2, [1.0])])).collect() == []
    # An anchor that is there twice: each is the other's positive; ties go to smaller ids.
    rows = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (3, 2, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (4, 2, [0.5, 0.0]), (5, 2, [0.8125, 0.0])]
    got = sorted(map(tuple, negatives.mine(vectors(spark, rows)).collect()))
    assert got == sorted(2 * [(100, 100, r, n, 65536, s) for r, n, s in ((1, 2, 65536), (2, 3, 65536), (3, 5, 53248))])
    # Large components stay exact.
    big = [(i, i % 2, [float(2**24 + 2 * i), 1.0]) for i in range(40)]
    assert sorted(map(tuple, negatives.hard_negatives(vectors(spark, big), F.col("vec_id") == 0, scale=1).collect())) == brute_negatives(big, lambda v: v == 0, scale=1)


def test_bounds_exclude(spark):
    """Far clusters are not sent, and whatever is excluded is farther than the bound."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (50, 8)) + 200 * np.eye(8, dtype=int)[i] for i in range(8)])
    norm = int((x * x).sum(1).max())
    s = negatives._Space(x[::50], norm, 8)
    own = s.distances(x, False)
    cell = own.argmin(1)
    for i in range(0, 400, 37):
        scores = x @ x[i]
        need = int(np.sort(scores)[-6])
        home = int(s.distances(x[i : i + 1], True).argmin())
        cells, lo, hi = negatives._reach(s, x[i : i + 1], home, np.array([need]))
        sent = np.zeros(len(x), bool)
        for c, a, b in zip(cells, lo, hi, strict=True):
            sent |= (cell == c) & (own[:, c] >= a) & (own[:, c] <= b)
        assert sent[scores >= need].all() and sent.sum() < 200


def brute_draw(docs, target, percent=10, min_words=20, buckets=10_000, seed=2024):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for w in words(text):
                held[zlib.crc32(w.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    rows = []
    for at, (doc, text) in enumerate(docs):
        ws = words(text)
        weight = sum(gain[zlib.crc32(w.encode()) % buckets] for w in ws)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, at])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v or 0) for v in r))


def test_resampling(spark, sf, documents, edge_docs, no_docs, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    target = [r.text for r in benchmark.collect()]
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = order(brute_draw(docs, target))
    run = lambda d, t, **k: order(map(tuple, resampling.digest(resampling.resample(d, t, **k)).collect()))
    assert run(documents, benchmark) == want
    # Many short runs and ranges, few known words: the same rows.
    for name, value in (("RUN_ROWS", 20), ("RANGE_ROWS", 6), ("PAGE", 2), ("WORDS", 50)):
        monkeypatch.setattr(resampling, name, value)
    assert run(documents.repartition(7), benchmark) == want
    assert run(documents.repartition(7), benchmark, percent=100) == order(brute_draw(docs, target, percent=100))
    edge = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for percent in (0, 40, 100):
        assert run(edge_docs, benchmark.limit(0), percent=percent) == order(brute_draw(edge, [], percent=percent))
    assert run(no_docs, benchmark) == []
    # Ties: rows of one id and text have one score; each is drawn by itself.
    same = [(1, "a " * 30)] * 50 + [(None, "b " * 30)] * 5
    table = spark.createDataFrame(same, "doc_id long, text string").repartition(4)
    got = run(table, benchmark, percent=50)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 28)) and got == order(brute_draw(same, target, percent=50))


def test_longer_features():
    assert resampling.features([b"a", b"b", b"c"], 3) == [b"a", b"b", b"c", b"a b", b"b c", b"a b c"]
    assert resampling.words("Ab-c Éé 9x\x00y_Z") == [b"ab", b"c", "Éé".encode(), b"9x", b"y", b"z"]


def test_tournament():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 8, 13):
        runs = []
        for _ in range(k):
            x = sorted((rng.randrange(20), 0, rng.randrange(5), rng.randrange(9), 1, 2) for _ in range(rng.randrange(0, 30)))
            runs.append(np.array(x, np.int64).reshape(-1, 6).T.tobytes())
        merged = list(resampling.Tournament([resampling._Run(r) for r in runs]))
        assert merged == sorted(tuple(r) for x in runs for r in np.frombuffer(x, np.int64).reshape(6, -1).T.tolist())
