import collections
import zlib

import numpy as np
import pyarrow as pa

from quartzframe.llm import packing as pk
from quartzframe.llm.token_store import tokenizer_path
from test_token_store import want

PATH = tokenizer_path(pk.TOKENIZER)


def check(rows, texts, window):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for key, t in texts:
        at, ids = 0, want(t, 1)
        for r in sorted(by[key], key=lambda r: r["start"]):
            raw = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(raw), raw)
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    return sequences


def test_every_id_lies_in_one_piece(spark, table):
    texts = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i * 13 % 300))) for i in range(60)] + [(100, None), (101, ""), (102, "very long " * 3000), (None, "no id")]
    p = pk.Packing(window=256, shard_tokens=4000)
    rows = pk.pack(table(*texts, extra=True), PATH, 1, p, with_ids=True).collect()
    sequences = check(rows, texts, 256)
    total = sum(r["length"] for r in rows)
    padding = sum(256 - n for s in sequences.values() if (n := sum(r["length"] for r in s)) & (n - 1))
    assert padding <= 256 * -(-total // 4000)  # at most the last sequence of each shard is padded
    assert pk.pack(table(), PATH, 1).count() == 0


def test_neighbours_share_a_window():
    topics = [np.repeat(np.arange(t * 40, t * 40 + 40), 2) for t in range(8)]
    rng = np.random.default_rng(1)
    docs = [rng.permutation(topics[i % 8])[:60].astype(np.uint32) for i in range(64)]
    df = np.zeros(320)
    for d in docs:
        df[np.unique(d)] += 1
    shard = pk.Shard(docs, np.log1p((64 - df + 0.5) / (df + 0.5)), 60.0, pk.Packing(window=480))
    out = pk.order(shard, 480)
    assert sorted(out) == list(range(64))
    assert all(len({d % 8 for d in out[i : i + 8]}) == 1 for i in range(0, 64, 8))


def test_scores_are_bm25():
    docs = [np.array(x, np.uint32) for x in ([1, 1, 2], [2, 3], [1, 3, 3, 3])]
    idf, p = np.array([0, 1.0, 2.0, 0.5]), pk.Packing()
    shard = pk.Shard(docs, idf, 3.0, p)
    for d in range(3):
        for e in range(3):
            score = 0.0
            for t in set(docs[d].tolist()):
                c = (docs[e] == t).sum()
                score += idf[t] * c * (p.k1 + 1) / (c + p.k1 * (1 - p.b + p.b * len(docs[e]) / 3.0))
            assert np.isclose(shard.scores(d)[e], score)


def test_last_sequence_has_little_padding():
    p = pk.Packing()
    for total in (1, 63, 64, 100, 1300, 2047, 2048, 2049, 5000):
        sizes = pk.lengths(total, p)
        assert sum(sizes) == total and max(sizes) <= 2048
        assert all(s & (s - 1) == 0 for s in sizes[:-1])


def test_shards_are_dealt_by_content(spark, table):
    pairs = [(i, " ".join(f"{chr(97 + t % 26)}{chr(97 + t // 26)}q{k}" * 3 for k in range(5)) + f" the of and to {i}") for i in range(200) for t in (i % 100,)]
    p = pk.Packing(window=64, shard_tokens=600)
    rows = pk.pack(table(*pairs), PATH, 1, p).collect()
    shards = {r["doc_id"]: r["sequence_id"] >> 32 for r in rows}
    assert len(set(shards.values())) >= 10
    assert sum(shards[i] == shards[i + 100] for i in range(100)) >= 80


def test_a_group_larger_than_a_shard_is_spread(spark, table):
    texts = [(i, "one and the same text of some length") for i in range(2000)] + [(9000 + i, f"other {i} things {i * 7}") for i in range(50)]
    rows = pk.pack(table(*texts), PATH, 1, pk.Packing(window=64, shard_tokens=1000)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["sequence_id"] >> 32] += r["length"]
    assert len(sizes) >= 10 and max(sizes.values()) <= 2000


def test_repeated_rows_are_spread(spark):
    for key in (7, None):
        docs = spark.createDataFrame([(key, "one two three four five six")] * 1500, "doc_id long, text string")
        rows = pk.pack(docs, PATH, 1, pk.Packing(window=64, shard_tokens=1000)).collect()
        held = collections.Counter()
        for r in rows:
            held[r["sequence_id"] >> 32] += r["length"]
        assert sum(held.values()) == sum(r["doc_tokens"] for r in rows if r["start"] == 0) and len([r for r in rows if r["start"] == 0]) == 1500
        assert len(held) >= sum(held.values()) // 1000 and max(held.values()) < 2000


def test_the_rest_of_a_long_document_is_followed_by_its_neighbours():
    docs = [np.repeat(np.arange(t * 10, t * 10 + 10), k).astype(np.uint32) for t, k in ((0, 15), (1, 5), (2, 5), (1, 5), (0, 5))]
    shard = pk.Shard(docs, np.ones(30), 70.0, pk.Packing(window=100))
    assert pk.order(shard, 100) == [0, 4, 1, 3, 2]


def test_more_than_64_neighbours_fill_a_window():
    docs = [np.array([1, 3 + i] if i % 2 == 0 else [2, 3 + i], np.uint32) for i in range(400)]
    out = pk.order(pk.Shard(docs, np.ones(500), 2.0, pk.Packing(window=300)), 300)
    assert out[:150] == list(range(0, 300, 2))
    scores = np.random.default_rng(2).integers(-3, 20, 1000) / 4
    assert list(pk.nearest(scores)) == [i for i in np.argsort(-scores, kind="stable").tolist() if scores[i] > 0]


def test_all_terms_of_a_long_text_count():
    docs = [np.arange(100, dtype=np.uint32), *(np.array([i], np.uint32) for i in range(100))]
    assert (pk.Shard(docs, np.linspace(1, 2, 100), 2.0, pk.Packing()).scores(0) > 0).all()


def test_used_documents_leave_the_index():
    """The order is that of the whole index, and what is searched shrinks with the documents left."""
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 300, rng.integers(1, 90)).astype("<u2") for _ in range(400)]
    p, idf = pk.Packing(window=256), rng.random(300)

    class Whole(pk.Shard):
        def drop(self, left):
            pass

    whole, shard = Whole(ids, idf, 40.0, p), pk.Shard(ids, idf, 40.0, p)
    assert pk.order(shard, 256) == pk.order(whole, 256)
    assert len(shard.owner) < len(whole.owner) / 4


def test_leading_ids_of_many_documents_at_once():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 70_000 if i % 2 else 9, rng.integers(0, 40)).astype("<u4" if i % 2 else "<u2") for i in range(200)]
    idf = np.round(rng.random(70_000), 1) + 0.1
    batch = pa.RecordBatch.from_arrays([pa.array([len(x) for x in ids]), pa.array([x.tobytes() for x in ids], pa.binary())], names=["n", "ids"])
    for got, x in zip(pk._keys(batch, idf).tolist(), ids):
        terms, counts = np.unique(x, return_counts=True)
        best = sorted(range(len(terms)), key=lambda i: (-counts[i] * idf[terms[i]], terms[i]))[: pk.KEYS]
        assert got == [int(terms[i]) for i in best] + [-1] * (pk.KEYS - len(best))


def test_ids_are_counted_in_linear_time():
    """Each document's ids are sorted as they are, in 2 bytes, and a query reads its postings in one step."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, n).astype(kind) for n, kind in ((0, "<u2"), (40, "<u2"), (1, "<u2"), (0, "<u2"), (300, "<u2"))]
    owner, terms, counts = pk.counted(docs)
    want = [(i, int(t), int(c)) for i, d in enumerate(docs) for t, c in zip(*np.unique(d, return_counts=True))]
    assert list(zip(owner.tolist(), terms.tolist(), counts.tolist())) == want
    assert pk.counted([])[0].tolist() == [] and pk.counted([np.array([70_000, 3, 70_000], "<u4")])[1].tolist() == [3, 70_000]
    idf = rng.random(50)
    shard = pk.Shard(docs, idf, 70.0, pk.Packing())
    for d in range(len(docs)):
        score = np.zeros(len(docs))
        for o, t in zip(*(x[np.isin(terms, np.unique(docs[d]))] for x in (owner, terms))):
            c = int((docs[o] == t).sum())
            score[o] += idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[o]) / 70.0))
        assert np.allclose(shard.scores(d), score)
