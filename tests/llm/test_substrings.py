import hashlib
import random
from collections import Counter

import numpy as np

from leafmill.llm import substrings as S


def marks(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def expected(rows):
    texts = [(r.text or "").encode() for r in rows]
    out = []
    for r, t, m in zip(rows, texts, marks(texts, 200), strict=True):
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        spans = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        out.append((r.doc_id, len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_index():
    random.seed(2)
    for _ in range(200):
        base = bytes(random.choice(b"ab\x00") for _ in range(60))
        texts = [b"".join(random.choice([base[random.randint(0, 30) : random.randint(31, 60)], bytes(random.choice(b"abc") for _ in range(random.randint(0, 9))), b"a" * random.randint(0, 20)]) for _ in range(random.randint(1, 5))) for _ in range(random.randint(1, 6))]
        length = random.choice([4, 8, 12])
        joined = b"\xff".join(texts) + b"\xff"
        assert S.suffix_array(np.frombuffer(joined, np.uint8)).tolist() == sorted(range(len(joined)), key=lambda i: joined[i:])  # noqa: B023
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        assert [m.tolist() for m in S.mark_bin(texts, length)] == [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]


def test_copies():
    """A text with a count is as many equal texts."""
    random.seed(5)
    for _ in range(100):
        texts = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 25))) for _ in range(random.randint(1, 6))]
        times = [random.randint(1, 3) for _ in texts]
        count = Counter(t[i : i + 6] for t, n in zip(texts, times, strict=True) for _ in range(n) for i in range(len(t) - 5))
        assert [m.tolist() for m in S.mark_bin(texts, 6, times)] == [[i for i in range(len(t) - 5) if count[t[i : i + 6]] > 1] for t in texts]


def test_window_hashes():
    random.seed(6)
    data = bytes(random.choice(b"ab") for _ in range(3000)) * 2
    for length in (8, 13, 200):
        seen = {}
        for i, h in enumerate(S.window_hashes(np.frombuffer(data, np.uint8), length).tolist()):
            assert seen.setdefault(h, data[i : i + length]) == data[i : i + length]
        assert len(seen) == len({data[i : i + length] for i in range(len(data) - length + 1)})


def test_segments_cover_windows_once():
    random.seed(3)
    for size in (0, 199, 200, 201, 5000, S.BLOCK + 777):
        data = bytes(random.choice(b"abcdefgh ") for _ in range(size))
        at = [i for h, first, n in S.segments(data) for f, c in zip(first.tolist(), n.tolist(), strict=True) for i in range(f, f + c)]
        assert at == list(range(max(0, size - 199)))


def test_documents(spark, documents):
    got = S.digest(S.dedup_substrings(documents)).collect()
    assert sorted(map(tuple, got), key=str) == expected(documents.collect())


def test_edges(spark, edge_docs, no_docs):
    found = S.dedup_substrings(edge_docs)
    assert sorted(map(tuple, S.digest(found).collect()), key=str) == expected(edge_docs.collect())
    assert {r.x for r in found.selectExpr("rest.ids AS x").collect()} == {r.ids for r in edge_docs.collect()}
    assert found.where("text IS NULL").count() == edge_docs.where("text IS NULL").count()
    assert S.dedup_substrings(no_docs).count() == 0


def test_hot_anchor(spark, monkeypatch):
    """The way for anchors with very many segments finds the same."""
    random.seed(4)
    shared = "".join(random.choice("abcdefghij ") for _ in range(450))
    word = lambda: "".join(random.choice("klmnopqrst ") for _ in range(random.randint(0, 300)))
    docs = spark.createDataFrame([(i, word() + shared[random.randint(0, 99) :] + word()) for i in range(40)], "doc_id long, text string")
    want = expected(docs.collect())
    assert sorted(map(tuple, S.digest(S.dedup_substrings(docs)).collect()), key=str) == want
    monkeypatch.setattr(S, "HOT", 3)
    assert sorted(map(tuple, S.digest(S.dedup_substrings(docs)).collect()), key=str) == want
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, S.digest(S.dedup_substrings(docs)).collect()), key=str) == want
