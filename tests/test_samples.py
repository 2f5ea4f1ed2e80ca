"""Confirmed samples: paths, hashes, boundaries and the last batch."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quartzframe.operators import samples

BOX = [[1.0, 1.0], [8.0, 1.0], [8.0, 8.0], [1.0, 8.0]]
HASH = "sha256:" + hashlib.sha256(b"scan").hexdigest()


def load(spark, entries, annotations, objects):
    e = spark.createDataFrame(entries, "batch string, position int, schema_version int, image_id string, object_path string")
    a = spark.createDataFrame(annotations, "batch string, annotation_id string, image_id string, boundary_corners array<array<double>>, supersedes_annotation_id string")
    o = spark.createDataFrame(objects, "path string, object_hash string")
    return {r["image_id"]: (r["object_path"], r["boundary_corners"], r["annotation_id"]) for r in samples.confirmed_samples(e, a, o).collect()}


def test_paths_below_the_root(spark):
    cases = {
        "objects/a.jpg": "batches/b1/objects/a.jpg", "../../objects/a.jpg": "objects/a.jpg", "./x//../a.jpg": "batches/b1/a.jpg", "../../../objects/a.jpg": None, "/objects/a.jpg": None,
        "../../../datasets-escape/scan.jpg": None, "../..": None, "": "batches/b1", None: None,
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r[0]: r[1] for r in rows.select("p", samples.resolved_path(F.lit("batches/b1"), F.col("p"))).collect()} == cases


def test_the_last_batch_of_an_image_counts(spark):
    moved = [[2.9, 1.0], *BOX[1:]]
    entries = [(b, 0, 1, HASH, "../../objects/scan.jpg") for b in ("batch-1", "batch-2")]
    notes = [("batch-1", "a1", HASH, BOX, None), ("batch-2", "a1", HASH, moved, None)]
    objects = [("objects/scan.jpg", HASH)]
    assert load(spark, entries, notes, objects) == {HASH: ("objects/scan.jpg", [[2, 1], [8, 1], [8, 8], [1, 8]], "a1")}
    # a batch without a whole record of the image leaves the one before
    for last in ([], [("batch-2", "a1", HASH, BOX[:3], None)], [("batch-2", "a1", HASH, [[None, 1.0], *BOX[1:]], None)], [("batch-2", "a1", HASH, [[float("inf"), 1.0], *BOX[1:]], None)], [("batch-2", "a1", HASH, None, None)], [("batch-2", "a1", HASH, [[1.0], *BOX[1:]], None)]):
        assert load(spark, entries, notes[:1] + last, objects)[HASH][1] == [[int(x) for x in p] for p in BOX]


@pytest.mark.parametrize(
    "version, path, objects",
    [
        (1, "objects/scan.jpg", []),
        (1, "objects/scan.jpg", [("objects/scan.jpg", HASH), ("batches/b/objects/scan.jpg", HASH)]),
        (1, "objects/scan.jpg", [("objects/scan.jpg", "sha256:other")]),
        (1, "../../../datasets-escape/scan.jpg", [("datasets-escape/scan.jpg", HASH)]),
        (2, "objects/scan.jpg", [("objects/scan.jpg", HASH)]),
        (1, None, [("objects/scan.jpg", HASH)]),
    ],
)
def test_objects_that_are_not_sure_are_left_out(spark, version, path, objects):
    assert load(spark, [("b", 0, version, HASH, path)], [("b", "a", HASH, BOX, None)], objects) == {}


def test_superseded_annotations_and_other_batches(spark):
    entries, objects = [("b", 0, 1, HASH, "o")], [("o", HASH)]
    chain = [("b", "a", HASH, BOX, None), ("b", "c", HASH, [[3.0, 3.0], *BOX[1:]], "a")]
    assert load(spark, entries, chain, objects)[HASH][2] == "c"
    assert load(spark, entries, [("other", "a", HASH, BOX, None)], objects) == {}
    # the same ids in another batch supersede nothing here
    assert load(spark, entries, [chain[0], ("other", "c", HASH, BOX, "a")], objects)[HASH][2] == "a"
    with pytest.raises(PySparkException, match="several current annotations"):
        load(spark, entries, [chain[0], ("b", "d", HASH, BOX, None)], objects)


def test_empty_tables(spark):
    assert load(spark, [], [], []) == {}
