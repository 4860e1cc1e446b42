import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import packing, token_store
from leafmill.llm.encoding import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_equals_library(whole, documents):
    enc = Encoder(PATH)
    assert enc.by_piece and enc.plain
    enc.limit = 50  # evictions change nothing
    for r in documents.collect():
        assert array("I", whole(r.text)).tobytes() == enc.encode(r.text)

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aB.,' \n\t\r-1éÉßİŉẞ́中  😀<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        assert array("I", whole(text)).tobytes() == enc.encode(text)

    same()
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # spaces belong to its tokens
    assert not other.by_piece and other.encode("a b c") == array("I", other.tokenizer.encode("a b c", add_special_tokens=False).ids).tobytes()


def test_lengths():
    assert packing.lengths(13, 8) == [8, 4, 1] and packing.lengths(0, 8) == [] and packing.lengths(16, 8) == [8, 8]


def check_pieces(rows, ids_of):
    for doc, ids in ids_of.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing(spark, documents, whole, edge_docs, no_docs, tmp_path):
    rows = packing.digest(packing.pack_power_of_two(documents, PATH)).collect()
    check_pieces(rows, {r.doc_id: whole(r.text) + [1] for r in documents.collect()})
    edge = packing.digest(packing.pack_power_of_two(edge_docs, PATH)).collect()
    once = [r for r in edge_docs.collect() if r.doc_id not in (2, None)]
    check_pieces([r for r in edge if r.doc_id not in (2, None)], {r.doc_id: whole(r.text) + [1] for r in once})
    assert sum(r.length for r in edge if r.doc_id == 2) == 2 * sum(r.length for r in edge if r.doc_id == 1)
    assert packing.pack_power_of_two(no_docs, PATH).count() == 0
    packing.write_buckets(packing.pack_power_of_two(documents, PATH), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == len(rows)
    lengths, batches = {}, {}
    for r in rows:
        assert 1 << r.bucket == r.length and lengths.setdefault(r.batch_id, r.length) == r.length
        batches.setdefault(r.batch_id, []).append(r.sequence_id)
    assert all(sorted(b) == list(range(min(b), min(b) + len(b))) for b in batches.values()) and len(batches) < len(rows) / 4
    with pytest.raises(ValueError, match="power"):
        packing.pack_power_of_two(documents, PATH, 1000)


def test_store(spark, documents, whole, edge_docs, no_docs):
    store = token_store.write_token_store(documents, PATH)
    at, want = 0, []
    for r in documents.orderBy("doc_id").collect():
        ids = whole(r.text) + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_store.read_documents(store, documents).collect())) == want
    assert [x.tolist() for x in store.get(want[3][0])] == [whole(documents.where(f"doc_id = {want[3][0]}").first().text) + [2]]
    assert store.get(10**15) == []
    edge = token_store.write_token_store(edge_docs, PATH)
    rows = token_store.read_documents(edge, edge_docs).collect()
    assert len(rows) == edge_docs.count() and sum(r.doc_id is None for r in rows) == 2
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert len(edge.get(2)) == 2 and edge.get(3)[0].tolist() == [2]
    empty = token_store.write_token_store(no_docs, PATH)
    assert token_store.read_documents(empty, no_docs).count() == 0 and empty.get(1) == []


def test_repeated_key(spark, whole):
    """The records of one id spread over tasks and shards; null ids come first, and apart from the least id."""
    docs = spark.range(0, 20_000, 1, 7).selectExpr("CASE WHEN id < 8000 THEN 5 WHEN id < 8010 THEN -9223372036854775808 WHEN id < 8030 THEN null ELSE id END AS doc_id", "concat('word ', id % 4000) AS text")
    store = token_store.write_token_store(docs, PATH, shards=6, shard_docs=700)
    shards = spark.read.parquet(f"{store.folder}/shards").collect()
    assert len(shards) >= 20_000 // 700 and len({r.shard >> token_store.SHARD_BITS for r in shards}) == 6
    rows = token_store.read_documents(store, docs).collect()
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert len(rows) == 20_000 and (count[5], count[-(2**63)], count[None]) == (8000, 10, 20)
    starts = sorted((r.start, r.n_tokens, r.doc_id is not None, -(2**63) if r.doc_id is None else r.doc_id) for r in rows)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2:] <= b[2:] for a, b in zip(starts, starts[1:], strict=False))
    crc = lambda t: zlib.crc32(array("I", whole(t) + [2]).tobytes())
    assert sorted(r.ids_crc32 for r in rows if r.doc_id == 5) == sorted(2 * [crc(f"word {i}") for i in range(4000)])
    assert len(store.get(5)) == 8000 and len(store.get(12_345)) == 1


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    blob = token_store.build_mph(keys)
    at = token_store.Mph(blob).slots(keys, token_store.level_sizes(len(keys), blob))
    assert sorted(at.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="distinct"):
        token_store.build_mph(np.array([1, 1]))


def test_stretches():
    first, ids = np.array([0, 5, 9, 20, 25]), np.array([5, 4, 6, 5, 100])
    assert [(s.start, s.stop) for s in token_store._stretches(first, ids)] == [(0, 3), (3, 5)]
    assert list(token_store._stretches(first[:0], ids[:0])) == []


def test_few_reads(spark, monkeypatch, tmp_path):
    """A scan of all keys reads stretches, not records."""
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    store = token_store.write_token_store(docs, PATH, shards=1, folder=f"file://{tmp_path}/s")
    assert token_store.read_documents(store, docs).count() == 500
    shard = token_store.Shard(f"{store.folder}/ids", 0)
    assert len(list(token_store._stretches(np.arange(0, 50, 5), np.full(10, 5)))) == 1 and len(shard.ids(0, 3)) == 3
    monkeypatch.setattr(token_store, "READ_IDS", 7)
    assert len(list(token_store._stretches(np.arange(0, 50, 5), np.full(10, 5)))) == 10
