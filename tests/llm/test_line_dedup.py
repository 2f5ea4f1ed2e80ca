import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzframe.llm import line_dedup as ld


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def varied(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        i, kind = rng.randrange(len(line) + 1), rng.randrange(3)
        if kind == 0:
            line.insert(i, rng.choice("abcé"))
        elif i < len(line):
            line[i : i + 1] = [rng.choice("abcé")] if kind == 1 else []
    return "".join(line)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_distance_segments_and_screen(most):
    rng = random.Random(most)
    for _ in range(4000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 16)))
        b = varied(rng, a, rng.randrange(0, 6))
        near = levenshtein(a, b) <= most
        assert ld.within(a, b, most) == near, (a, b)
        if near and a != b and min(len(a), len(b)) > most:
            assert keys_meet(a, b, ld.LineDedup(edits=most, least=most + 1)), (a, b)
            flips = [((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(ld.parities(a), ld.parities(b))]
            assert flips[0] <= 2 * most and sum(flips[1:]) <= 4 * most


def keys_meet(a, b, p):
    zeros = np.zeros(2, np.int64)
    own, every = [set(), set()], [set(), set()]
    for _, probing, rows, keys, _, _ in ld.Substrings([a, b]).keys(zeros, zeros, zeros - 1, p):
        for r, k in zip(rows.tolist(), keys.tolist()):
            every[r].add(k)
            if not probing:
                own[r].add(k)
    return own[0] & every[1] or own[1] & every[0]


def brute(docs, p):
    places = [(i, j, line) for i, t in sorted(docs, key=lambda d: d[0]) for j, line in enumerate((t or "").split("\n")) if len(line) >= p.least]
    lines = sorted({x[2] for x in places})
    parent = {x: x for x in lines}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= p.edits and levenshtein(a, b) <= p.edits:
                parent[root(a)] = root(b)
    degree = {x: sum(root(y) == root(x) for y in lines) - 1 for x in lines}  # other lines of the class
    first = {}
    for i, j, line in places:
        first.setdefault(root(line), (i, j))
    rows, texts = {}, {}
    for i, t in docs:
        mine = [x for x in places if x[0] == i]
        rows[i] = (len(mine), sum(first[root(x[2])] != x[:2] for x in mine), sum(degree[x[2]] for x in mine), min((first[root(x[2])][0] for x in mine), default=i))
        gone = {x[1] for x in mine if first[root(x[2])] != x[:2]}
        texts[i] = t if not gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
    return rows, texts


@pytest.mark.parametrize("edits", [1, 2])
def test_against_brute_force(spark, table, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(18, 40))) for _ in range(12)]
    docs = [(i, "\n".join(varied(rng, rng.choice(base), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 6)))) for i in range(60)] + [(99, None), (98, ""), (97, "short"), (96, "x" * 30_000), (95, "y" * 900 + "\n" + "y" * 901)]
    p = ld.LineDedup(edits=edits)
    rows, texts = brute(docs, p)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["n_near"], r["class_id"]) for r in ld.dedup(table(*docs, extra=True), p).collect()}
    assert got == rows
    if edits == 1:
        return
    clean = ld.clean(table(*docs, extra=True), p)
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == texts
    assert clean.columns == table((1, ""), extra=True).columns


def test_edge_tables(spark, table):
    assert ld.dedup(table()).count() == 0 and ld.clean(table()).count() == 0
    same = "one and the same line of text"
    got = sorted((r["doc_id"] or -1, r["n_dropped"]) for r in ld.dedup(table((None, same), (1, same), (1, same), (2, same))).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 1)]


def test_a_changed_year_or_word_is_linked(spark, table):
    lines = ["Copyright of the authors, all rights reserved, 2019", "Copyright of the authors, all rights reserved, 2020", "This page was read by one of our many visitors", "This page was read by two of our many visitors"]
    docs = list(enumerate(lines)) + [(9, "a line that has no other near it in this table")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["n_near"], r["class_id"]) for r in ld.dedup(table(*docs)).collect()}
    assert got == brute(docs, ld.LineDedup())[0]
    assert [got[i][1] for i in (0, 1, 2, 3, 9)] == [0, 1, 0, 1, 0]


@pytest.mark.parametrize("levels,group", [(1, 8), (3, 8), (3, 512)])
def test_hot_keys_lose_no_link(spark, table, levels, group):
    rng = random.Random(levels)
    head = "all of these lines begin with one and the same long half, then "
    docs = [(i, head + "".join(rng.choice("abc") for _ in range(rng.choice([9, 10, 11])))) for i in range(120)]
    p = ld.LineDedup(edits=2, group=group, levels=levels)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["n_near"], r["class_id"]) for r in ld.dedup(table(*docs), p).collect()}
    assert got == brute(docs, p)[0]


def test_lines_that_share_a_half_give_few_pairs(spark):
    n = 20_000
    half = "the same half of a line stands at the begin of all of these "
    lines = spark.range(n).select("id", F.concat(F.lit(half), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 60)).alias("line"), F.col("id").alias("label"))
    met = ld.candidates(lines, ld.LineDedup())
    assert met.count() < 2 * n and (met.agg(F.sum("n")).first()[0] or 0) < 2 * n


def test_near_misses_cost_no_rows(spark):
    """Lines that differ in one word pass the screens in many pairs, and those of them that are linked are found."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(150)]
    texts = sorted({f"a form of a line in which the one word {w} is another each time it is met" for w in words})
    p = ld.LineDedup()
    met = ld.candidates(spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "id long, line string, label long"), p)
    n_pairs, n_rows = met.agg(F.sum("n")).first()[0], met.count()
    parent = list(range(len(texts)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    got = [tuple(r) for r in ld.links(met, p).collect()]
    for a, b in got:
        assert levenshtein(texts[a], texts[b]) <= p.edits
        parent[root(a)] = root(b)
    want = [(i, j) for i, a in enumerate(texts) for j in range(i) if levenshtein(a, texts[j]) <= p.edits]
    assert want and all(root(i) == root(j) for i, j in want)
    assert n_rows <= 26 * len(texts) < n_pairs


def test_columns_named_like_helpers_survive(spark, table):
    line = "a line that occurs in two documents"
    docs = table((1, line), (2, line + "\nand another one that is not repeated")).selectExpr("*", "'x' AS _gone", "1 AS _doc", "2 AS _kept")
    out = ld.clean(docs)
    assert out.columns == docs.columns and {r["doc_id"]: (r["text"], r["_gone"]) for r in out.collect()} == {1: (line, "x"), 2: ("and another one that is not repeated", "x")}


def test_dense_classes_list_no_pairs(spark, table):
    """Hundreds of lines within a few edits of each other are one class, and cost rows in proportion."""
    lines = spark.range(600).select("id", F.concat(F.lit("one line of a form that is filled in hundreds of times, number "), F.lpad(F.col("id").cast("string"), 3, "0")).alias("line"))
    out = ld.dedup(lines.select(F.col("id").alias("doc_id"), F.col("line").alias("text")))
    assert [tuple(r) for r in out.groupBy("class_id", "n_near").count().collect()] == [(0, 599, 600)]
    assert ld.candidates(lines.withColumn("label", F.lit(0).cast("long")), ld.LineDedup()).count() == 0


def test_filter_holds_back_texts_of_many_ids(spark):
    """With 200,000 ids wanted, as 1 GB has, few of the other lines' texts pass."""
    lines = spark.range(1_000_000)
    met = lines.where("id % 5 = 0")
    kept = ld.within_bits(lines, F.xxhash64("id"), met, F.xxhash64("id"), ld.SLOT_WORDS).selectExpr("count_if(id % 5 = 0) AS met", "count_if(id % 5 > 0) AS others").first()
    assert kept["met"] == 200_000 and kept["others"] < 20_000


def test_hub_index_is_sorted_by_one_number(spark):
    p = ld.LineDedup()
    lines = [f"the same beginning of a line {i % 7} and end {i % 3}" for i in range(30)]
    rows = [(i, x, 0, ld.FULL, -1, 0, 0, 0, 0) for i, x in enumerate(lines)]
    level = spark.createDataFrame(rows, ", ".join(f"{c} string" if c == "line" else f"{c} long" for c in ld.LEVEL))
    index = ld.index(level, p, carry=False)
    found = [r for r in index.collect() if r["who"] >= 0]
    assert all(r["key"] & 1 == r["who"] & 1 for r in found)
    want, owner = set(), {}
    for r in sorted((r for r in ld.index(level, p).collect() if r["who"] >= 0), key=lambda r: r["who"] & 1):
        if r["who"] & 1 == 0:
            owner.setdefault(r["key"] | 1, set()).add(r["who"] >> 2)
        want.add((r["key"] | 1, r["who"] >> 2))
    got = {(r["a"], r["b"]) for r in ld.hubs(index).collect()}
    assert all(any((min(h, i), max(h, i)) in got for h in owner[k]) for k, i in want if k in owner and owner[k] != {i})


def test_shuffles_go_with_their_tables(spark, table):
    """Nothing of the shuffles behind written tables stays while later ones are made, and the session's setting is as before."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: sum(manager.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(manager.getAllFiles().size()))
    docs, name, before = table(*((i, f"the very same line of text, {i % 7}\nanother line that is quite long {i}") for i in range(60))), next(iter(ld.SHUFFLES_GO)), files()
    was = spark.conf.get(name, None)
    gone = ld.dropped(docs, ld.LineDedup())
    assert spark.conf.get(name, None) == was
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    assert gone.where("doc_id = 7").count() == 2
