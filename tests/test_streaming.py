import datetime as dt

from quartzframe.streaming import logs


def run(query):
    query.processAllAvailable()
    query.stop()


def test_stream_dedup_windows_and_leases(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("1", "a", base), ("1", "a", base), ("2", "a", base + dt.timedelta(seconds=20)), ("3", "b", base + dt.timedelta(minutes=90))]
    spark.createDataFrame(rows, "id string, who string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = logs.stream_log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    run(logs.dedup_stream(stream, ["id"], "ts").writeStream.format("memory").queryName("once").start())
    assert spark.table("once").count() == 3
    run(logs.windowed_counts(stream, "ts", ["who"]).writeStream.outputMode("complete").format("memory").queryName("hours").start())
    assert {(r["who"], r["n"]) for r in spark.table("hours").collect()} == {("a", 3), ("b", 1)}
    run(logs.leases(stream, "ts", "who").writeStream.outputMode("complete").format("memory").queryName("leases").start())
    assert {(r["who"], r["renewals"]) for r in spark.table("leases").collect()} == {("a", 3), ("b", 1)}


def test_latest_table(spark, tmp_path):
    spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, pos int, v string").write.parquet(str(tmp_path / "in"))
    stream = logs.stream_log(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    target = str(tmp_path / "out")
    run(stream.writeStream.foreachBatch(logs.keep_latest(target, "k", ["pos"])).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert [r["v"] for r in spark.read.parquet(f"{target}/v0").collect()] == ["new"]
