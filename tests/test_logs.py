import pytest
from pyspark.sql import functions as F

from quartzframe.functions import identity
from quartzframe.operators import logs, splits
from quartzframe.sources import readers, sinks


def chain(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, image string, pos long, target string")


def kinds(df):
    return sorted({r["violation"] for r in df.collect()})


def test_latest_is_by_position(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "x")], "k string, pos int, v string")
    assert {r["k"]: r["v"] for r in logs.latest_by_key(df, ["k"], ["pos"]).collect()} == {"a": "new", "b": "x"}


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("1", "a", 1, None), ("2", "a", 2, "1")], []),
        ([("1", "a", 1, None), ("1", "a", 2, None)], ["duplicate_id", "several_heads"]),
        ([("1", "a", 1, "9")], ["unknown_target"]),
        ([("1", "a", 1, None), ("2", "b", 2, "1")], ["cross_key_target"]),
        ([("1", "a", 1, "2"), ("2", "a", 2, "1")], ["later_target"]),
        ([("1", "a", 1, None), ("2", "a", 2, "1"), ("3", "a", 3, "1")], ["branch", "several_heads"]),
    ],
)
def test_chain_violations(spark, rows, expected):
    assert kinds(logs.chain_violations(chain(spark, *rows), "id", "target", "image", "pos")) == expected


def test_append_is_idempotent_and_finds_conflicts(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, body string")
    assert sinks.append_events(path, first, "id", ["body"]) == 2
    assert sinks.append_events(path, first, "id", ["body"]) == 0
    with pytest.raises(ValueError):
        sinks.append_events(path, spark.createDataFrame([("2", "z")], "id string, body string"), "id", ["body"])
    assert spark.read.parquet(path).count() == 2


def test_strict_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2, "b": "x y"}\n', encoding="utf-8")
    got = readers.read_jsonl(spark, str(good), "a int, b string").orderBy("position").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, None), (2, "x y")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n[1, 2]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        readers.read_jsonl(spark, str(bad), "a int").collect()


def test_image_files_and_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "in" / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n456")
    (tmp_path / "in" / ".hidden.png").write_bytes(b"\x89PNG\r\n\x1a\n456")
    (tmp_path / "in" / "note.txt").write_bytes(b"x")
    files = readers.read_image_files(spark, str(tmp_path / "in"))
    assert sorted((r["relative_path"], r["extension"]) for r in files.collect()) == [("a.jpg", ".jpg"), ("b.png", ".png")]
    objects = sinks.archive_objects(files.unionByName(files), spark.createDataFrame([], "object_key string"), "content")
    assert objects.count() == 2


def test_names_are_resolved_or_refused(spark):
    files = spark.createDataFrame([("x/a.jpg",), ("y/a.jpg",), ("y/b.jpg",)], "path string")
    entries = spark.createDataFrame([("x/a.jpg",), ("a.jpg",), ("b.jpg",), ("../b.jpg",), ("c.jpg",)], "name string")
    got = {r["name"]: (r["resolved"], r["reason"]) for r in readers.unique_names(entries, files, "name", "path").collect()}
    assert got == {"x/a.jpg": ("x/a.jpg", None), "a.jpg": (None, "ambiguous"), "b.jpg": ("y/b.jpg", None), "../b.jpg": (None, "unsafe"), "c.jpg": (None, "missing")}


def test_splits_are_stable_and_keep_old_assignments(spark):
    ids = spark.createDataFrame([(f"sha256:{i}",) for i in range(500)], "id string")
    a = {r["id"]: r["split"] for r in splits.stable_split(ids, "id", "s", "v1").collect()}
    b = {r["id"]: r["split"] for r in splits.stable_split(ids.orderBy(F.desc("id")), "id", "s", "v1").collect()}
    assert a == b and 250 < sum(v == "train" for v in a.values()) < 450
    old = ids.limit(5).withColumn("split", F.lit("frozen_test"))
    kept = {r["id"]: r["split"] for r in splits.extend_split(old, ids, "id", "s", "v1").collect()}
    assert all(kept[r["id"]] == "frozen_test" for r in old.collect()) and len(kept) == 500


def test_canonical_identity(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1e-07, null], "t": 5}',), ('{"t": 6, "a": [1e-7, null], "b": 1}',)], "j string")
    assert df.select(identity.canonical_hash(F.col("j"), without=("t",)).alias("h")).distinct().count() == 1
    assert spark.range(1).select(identity.round_half_even(F.lit(2.675), 2).alias("v")).first()["v"] == 2.67
    times = spark.createDataFrame([("2024-01-01T00:00:00+00:00",), ("2024-01-01T00:00:00",), ("2024-13-01T00:00:00Z",)], "t string")
    assert [r["v"] for r in times.select(identity.is_timestamp_with_offset(F.col("t")).alias("v")).collect()] == [True, False, False]


def test_a_batch_is_held_against_itself(spark):
    stored = spark.createDataFrame([("a", "x")], "id string, body string")
    batch = spark.createDataFrame([("b", "x"), ("b", "y"), ("c", "z"), ("c", "z"), ("a", "x")], "id string, body string")
    fresh, clash = logs.append_new(stored, batch, "id", ["body"])
    assert [tuple(r) for r in fresh.collect()] == [("c", "z")] and sorted(tuple(r) for r in clash.collect()) == [("b", "x"), ("b", "y")]


def test_a_value_of_another_type_raises(spark, tmp_path):
    path = tmp_path / "wrong.jsonl"
    path.write_text('{"a": 1}\n{"a": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed|cannot be parsed|CANNOT_PARSE"):
        readers.read_jsonl(spark, str(path), "a int").collect()
