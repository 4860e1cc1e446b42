import random
import re

import duckdb
import numpy as np

from leafmill.llm import jaccard as J
from leafmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, len(s), least.get(find(i), doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(docs):
    return sorted(map(tuple, J.similar_documents(docs).collect()), key=str)


def near_copies(seed, n):
    """Families of texts whose similarities lie on both sides of the threshold."""
    random.seed(seed)
    rows = []
    for family in range(n):
        base = [f"w{random.randint(0, 40 if family % 3 else 5000)}" for _ in range(random.choice([3, 5, 6, 20, 60, 200]))]
        for _ in range(random.randint(1, 12)):
            words = list(base)
            for _ in range(random.randint(0, max(1, len(words) // 25))):
                words[random.randrange(len(words))] = random.choice(["X", "y", f"z{random.randint(0, 999)}"])
            rows.append((len(rows), random.choice([" ", "  ", "\n"]).join(words[: random.randint(max(1, len(words) - 8), len(words))])))
    return rows


def test_near_copies(spark, monkeypatch):
    for seed in (1, 2):
        rows = near_copies(seed, 40)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = brute(rows)
        assert len({c for _, _, c in want}) < len(rows) - 20
        assert run(docs) == want
    # Groups in blocks: the same links, however small the blocks are.
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "BUCKET_POSTINGS", 500)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 40)
    assert run(docs) == want


def test_bloom(spark):
    bits = J.bloom(spark.range(0, 5000, 5).withColumnRenamed("id", "rep"))
    assert len(bits) == J.BLOOM_BITS // 64 and 1900 < np.bitwise_count(bits).sum() <= 2000
    docs = spark.range(5000).selectExpr("id AS doc_id", "'x' AS text")
    got = {r.rep for r in J._of(docs.unionByName(docs), spark.range(0, 5000, 5).withColumnRenamed("id", "rep")).collect()}
    assert set(range(0, 5000, 5)) <= got and len(got) < 1010


def test_refine(spark):
    """Sets of a group that share no prefix token under another order leave it; linked ones stay together."""
    rows = [r for r in near_copies(3, 30) if WORD.findall(r[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    node = {d: J.node_of(J.shingles(t)) for d, t in rows}
    named = spark.createDataFrame(sorted((n, min(d for d in node if node[d] == n)) for n in set(node.values())), "node long, rep long")
    groups = named.selectExpr("0L AS a", "node")  # all in one group
    left = {}
    for r in J._refine(groups, named, None, docs).collect():
        left.setdefault(r.a, set()).add(r.node)
    together = {(x, y) for g in left.values() for x in g for y in g}
    sets = {node[d]: J.shingles(t) for d, t in rows}
    for x in sets:
        for y in sets:
            if x < y and J.linked(len(sets[x]), len(sets[y]), len(np.intersect1d(sets[x], sets[y]))):
                assert (x, y) in together
    assert len(together) < 0.3 * len(sets) ** 2


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert run(edge_docs) == brute(rows)
    assert run(no_docs) == []


def test_null_bridge(spark):
    """A null doc_id links two documents that are no near copies of each other."""
    words = [f"w{i}" for i in range(210)]
    a, bridge, c = words[:180], words[20:200], words[40:]
    rows = [(3, " ".join(a)), (None, " ".join(bridge)), (8, " ".join(c)), (None, "q " * 3), (20, " ".join(f"v{i}" for i in range(50)))]
    rows += [(None, " ".join(f"u{i}" for i in range(k, 60))) for k in range(2)]
    want = brute(rows)
    assert (8, 166, 3) in want and (8, 166, 8) in brute([r for r in rows if r[0] is not None])
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_oracle(spark, sf, documents):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert run(documents) == sorted(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({J.ORACLE})").fetchall(), key=str)


def test_components(spark):
    random.seed(7)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    want = sorted((x, find(x)) for x in root)
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
