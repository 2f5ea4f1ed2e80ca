from pyspark.sql import functions as F

from quartzframe.llm.common import hot_keys, keyed_join, materialize, ordered_buckets, release, scratch_mark, within_bits


def test_an_outlier_leaves_the_ranges_even(spark):
    ids = [*range(20_000), 10**17, None, 7]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = ordered_buckets(df, "id")(df).collect()
    sizes = {}
    for r in got:
        sizes[r["_bucket"]] = sizes.get(r["_bucket"], 0) + 1
    assert len(got) == len(ids) and sizes[-1] == 1 and max(sizes.values()) <= 4096
    order = sorted((r["id"], r["_bucket"]) for r in got if r["id"] is not None)
    assert [b for _, b in order] == sorted(b for _, b in order)
    assert ordered_buckets(df.limit(0), "id")(df.limit(0)).count() == 0


def test_hot_keys_are_dealt_and_lose_nothing(spark):
    left = spark.range(9000).select("id", F.when(F.col("id") < 5000, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left, ["k"])
    assert len(hot) == 1
    joined = keyed_join(left, right, ["k"], hot=hot)
    assert joined.count() == 9000 and joined.where("v <> 2 * k").count() == 0


def test_release_frees_all_but_one(spark):
    mark = scratch_mark()
    a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    release(spark, mark, keep=b)
    assert b.count() == 4 and scratch_mark() == mark + 1 and a.scratch_path != b.scratch_path


def test_bits_lose_no_row_and_hold_back_most(spark):
    df = spark.range(-4000, 4000).withColumn("h", F.xxhash64("id"))
    wanted = df.where("id % 50 = 0")
    kept = {r["id"] for r in within_bits(df, F.col("h"), wanted, F.col("h"), words=64).collect()}
    assert {i for i in range(-4000, 4000) if i % 50 == 0} <= kept and len(kept) < 1000
