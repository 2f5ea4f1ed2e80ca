import math
import random

import numpy as np

from quartzframe.llm import near_dedup as nd


def words(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()


def shingle_set(t):
    w = words(t)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(25):
            copy = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            docs.append(" ".join(copy) + rng.choice(["", " ", "\n"]))
    docs += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_against_brute_force(spark, table):
    docs = corpus(1) + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, "x y " * 30_000), (None, "a b"), (None, None)]
    assert found(nd.dedup(table(*docs, extra=True))) == brute(docs)


def test_filter_keeps_one_of_each_group(spark, table):
    docs = corpus(2)
    kept = nd.filter_documents(table(*docs, extra=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in brute(docs) if r[3]]
    assert kept.columns == table((1, ""), extra=True).columns


def test_repeated_rows_and_empty_table(spark, table):
    text = "one two three four five six seven"
    assert found(nd.dedup(table((1, text), (1, text), (2, text)))) == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False)]
    assert nd.dedup(table()).count() == 0


def test_sketches_estimate_and_never_lose():
    rng = np.random.default_rng(3)
    p = nd.NearDedup()
    for share in (0.75, 0.8, 0.9, 0.97):
        errors = []
        for _ in range(40):
            n = int(rng.integers(100, 1500))
            same = math.ceil(n * 2 * share / (1 + share))  # of two sets of n members
            pool = rng.integers(0, 2**63, 2 * n - same, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - same :])
            xor = lambda f: sum(int(x).bit_count() for x in (f(a).view(np.uint64) ^ f(b).view(np.uint64)).tolist())  # noqa: B023, E731
            both = len(np.intersect1d(a, b))
            differing = xor(lambda s: nd.odd_sketch(nd.signature(s, p), p))
            exact = both / (len(a) + len(b) - both)
            errors.append(nd.sketch_estimate(differing, p) - exact)
            assert differing <= nd.most_differing(p)
            assert xor(lambda s: nd.whole_sketch(s, p)) <= len(a) + len(b) - 2 * both
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    from quartzframe.llm.common import components

    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
