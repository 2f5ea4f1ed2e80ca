import hashlib
import unicodedata

from pyspark.sql import functions as F

from quartzframe.llm import fingerprint as f

TEXTS = ["Hello  World", "hello world ", "Ｈello\tworld", "", None, "abc", "É", "É", "other text here", "other text here", "a" * 9000]


def test_equal_in_canonical_form(spark, table):
    got = {r["doc_id"]: r for r in f.fingerprints(table(*enumerate(TEXTS), extra=True)).collect()}
    same = lambda *ids: len({got[i]["fingerprint"] for i in ids}) == 1
    assert same(0, 1, 2) and same(3, 4) and same(6, 7) and same(8, 9) and not same(0, 5) and not same(5, 8)
    assert got[0]["group_size"] == 3 and got[5]["n_chars"] == 3


def test_canonical_form(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string").select("t", f.canonical(F.col("t")).alias("c"))
    for r in df.collect():
        want = " ".join(unicodedata.normalize("NFKC", r["t"]).upper().lower().split())
        assert r["c"] == want


def test_edited_texts(spark, table):
    rows = [(10 * i, t) for i, t in enumerate(TEXTS)] + [(7, "in between the others")]
    got = {r["doc_id"]: r for r in f.edited_fingerprints(table(*rows)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        part = len(t) // 4
        edited = t[: len(t) - part] + nxt[:part]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        canon = lambda x: " ".join(unicodedata.normalize("NFKC", x).upper().lower().split())
        assert r["near_edited"] == float(canon(edited) == canon(t)) and r["near_next"] == float(canon(nxt) == canon(t))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (canon(edited) == canon(t))


def test_next_over_many_ranges_and_gaps(spark):
    ids = [i * 3 + (i // 700) * 10_000 for i in range(6000)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["next"] for r in f.with_next(docs, "doc_id", "text").collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_empty_table_and_null_id(spark, table):
    assert f.edited_fingerprints(table()).count() == 0
    got = f.edited_fingerprints(table((None, "x y"), (1, "a b"))).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [None, 1]


def test_collisions_are_told_apart(spark, table, monkeypatch):
    monkeypatch.setattr(f, "digest", lambda c: (F.length(c).cast("long"), F.lit(1).cast("long")))
    got = {r["doc_id"]: r["fingerprint"] for r in f.fingerprints(table((1, "aa"), (2, "bb"), (3, "bb"), (4, "ccc"))).collect()}
    assert got[2] == got[3] and len(set(got.values())) == 3


def test_copies_are_compared_in_one_shuffle(spark, table, tmp_path):
    """Whole texts of copies are sent once, and nothing is sent again for ids or first documents."""
    docs = table(*((i, f"text {i % 40} " + "long " * 500) for i in range(120)))
    docs.write.parquet(f"{tmp_path}/docs")
    got = f.collided(spark.read.parquet(f"{tmp_path}/docs"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 0


def test_collisions_among_copies_and_null_ids(spark, table, monkeypatch):
    monkeypatch.setattr(f, "digest", lambda c: (F.length(c).cast("long"), F.lit(1).cast("long")))
    rows = [(3, "bb"), (1, "bb"), (None, "aa"), (2, "cc"), (4, "aa"), (4, "aa"), (5, "ddd"), (6, "ddd")]
    got = sorted((r["doc_id"], r["ordinal"]) for r in f.collided(table(*rows)).collect())
    assert got == [(2, 2), (4, 1)]
