import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quartzframe.functions import geometry as g
from quartzframe.functions import identity
from quartzframe.operators import coordinates as co

SCHEMA = f"""name string, annotation_id string, image_id string, run_id string, annotation_provenance string, boundary_corners {g.QUAD},
    run struct<run_id:string,batch_id:string,run_artifact_hash:string,git_available:boolean,git_dirty:boolean,git_commit:string,opencv:string>,
    run_image struct<run_id:string,image_id:string,legacy_import:boolean,source_original_size:array<int>,normalized_size:array<int>,original_size:array<int>,orientation_transform:string>,
    rule struct<coordinate_space:string,batch_id:string,evidence_document_hash:string>,
    loaded struct<source_sha256:string,exif_orientation:int,original_size:array<int>,full_normalized_size:array<int>,analysis_size:array<int>,orientation_transform:string,
        forward_transform:array<array<double>>,inverse_transform:array<array<double>>,analysis_to_full_transform:array<array<double>>>"""
TURN, BACK, TWICE = [[0.0, -1.0, 99.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [[0.0, 1.0, 0.0], [-1.0, 0.0, 99.0], [0.0, 0.0, 1.0]], [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 1.0]]
LOADED = ("ab12", 6, [200, 100], [200, 400], [100, 200], "rotate", TURN, BACK, TWICE)
QUAD = [(10.0, 10.0), (60.0, 10.0), (60.0, 40.0), (10.0, 40.0)]
RUN, IMAGE, RULE = ("r", "b", "h", True, False, "c0", "4.9"), ("r", "i", True, None, None, None, None), (co.STORED, "b", "sha256:1")


def row(name, run=RUN, image=IMAGE, rule=None, provenance='{"by": "é"}', quad=QUAD, ids=("a", "i", "r")):
    return (name, *ids, provenance, quad, run, image, rule, LOADED)


def sha(value):
    return "sha256:" + hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


CONFIRMED = ("r", "i", False, [200, 100], [200, 400], None, "rotate")
SIZED = ("r", "i", False, None, None, [200, 400], None)
ROWS = [
    row("imported", rule=RULE), row("confirmed", image=CONFIRMED), row("clean", image=SIZED),
    row("dirty", image=SIZED, run=(*RUN[:4], True, *RUN[5:])), row("other_batch", rule=(co.STORED, "x", "sha256:1"), image=CONFIRMED), row("no_provenance", rule=RULE, provenance=None),
    row("other_run", image=("x", *CONFIRMED[1:])), row("no_id", image=CONFIRMED, ids=("", "i", "r")), row("null_id", image=CONFIRMED, ids=(None, "i", "r")), row("nothing"),
]


@pytest.fixture(scope="module")
def proven(spark):
    return co.sealed(co.decided(spark.createDataFrame(ROWS, SCHEMA)))


def test_decisions(proven):
    got = {r["name"]: r for r in proven.collect()}
    assert {k: r["evidence"] and r["evidence"]["kind"] for k, r in got.items() if r["reason"] is None} == {"imported": co.IMPORTED, "confirmed": co.CONFIRMED, "clean": co.CLEAN_RUN}
    assert {k: r["reason"] for k, r in got.items() if r["reason"]} == {"dirty": "ambiguous", "other_batch": "stored_rule", "no_provenance": "stored_rule", "other_run": "identity", "no_id": "identity", "null_id": "identity", "nothing": "ambiguous"}
    assert got["imported"]["evidence"]["identity"] == sha({"annotation_id": "a", "batch_id": "b", "run_id": "r", "annotation_provenance": {"by": "é"}, "evidence_document_hash": "sha256:1", "run_artifact_hash": "h"})
    assert got["confirmed"]["evidence"]["identity"] == sha({"annotation_id": "a", "batch_id": "b", "run_id": "r", "source_original_size": [200, 100], "normalized_size": [200, 400], "orientation_transform": "rotate", "run_artifact_hash": "h"})
    for r in got.values():
        p = r["provenance"]
        assert (p is None) == (r["reason"] is not None)
        if p:
            whole = p.asDict(recursive=True)
            assert whole.pop("provenance_id") == sha(whole) and p["evidence_hash"] == sha(whole["evidence"])
            transform = dict(zip(("source_sha256", "exif_orientation", "original_size", "full_normalized_size", "analysis_size", "", "forward_transform", "inverse_transform", "analysis_to_full_transform"), LOADED))
            transform.pop("")
            assert p["transform_hash"] == sha(transform | {"source_sha256": "sha256:ab12"})


def test_resolved_and_refused(proven):
    good = proven.where("provenance IS NOT NULL")
    got = {r["name"]: r for r in co.resolved(proven).collect()}
    assert [tuple(p) for p in got["confirmed"]["truth"]] == QUAD
    assert [tuple(p) for p in got["imported"]["truth"]] == [(2 * (99 - y), 2 * x) for x, y in QUAD]
    assert got["nothing"]["refused"] == "missing" and got["nothing"]["truth"] is None
    p, l = F.col("provenance"), F.col("loaded")  # noqa: E741
    changes = {
        "hash": ("provenance", p.withField("coordinate_space", F.lit("x"))), "schema": ("provenance", p.withField("schema_version", F.lit(2))), "annotation": ("image_id", F.lit("z")),
        "transform": ("loaded", l.withField("exif_orientation", F.lit(1))), "bounds": ("boundary_corners", F.transform("boundary_corners", lambda q: g.point(q["x"] + 500, q["y"]))),
        "convex": ("boundary_corners", F.transform("boundary_corners", lambda q: g.point(F.lit(5), q["y"]))), "corners": ("boundary_corners", F.lit(None).cast(g.QUAD)),
    }
    changed = None
    for reason, (name, value) in changes.items():
        one = good.where("name = 'confirmed'").withColumn(name, value).withColumn("name", F.lit(reason))
        changed = one if changed is None else changed.unionByName(one)
    for r in co.resolved(changed).collect():
        assert r["refused"] == r["name"] and r["truth"] is None


def test_required_raises(spark):
    frame = spark.createDataFrame([("x", None), ("y", "ambiguous")], "v string, reason string")
    assert frame.where("v = 'x'").select(co.required(F.col("v"), F.col("reason"))).first()[0] == "x"
    with pytest.raises(Exception, match="ambiguous"):
        frame.select(co.required(F.col("v"), F.col("reason"))).collect()


def test_plain_structs_are_hashed_as_python_writes_them(spark, monkeypatch):
    """Spark writes them with sorted fields; before, Python read and wrote each again."""
    schema = "s struct<z:string,a:array<int>,n:bigint,b:boolean,o:struct<y:string,x:int>>"
    texts = ['é"/\\\u007f 😀', "\x00\x0b\x1f\n\\u000B \\\x1a", "", None]
    frame = spark.createDataFrame([((t, [1, -2], 1 << 60, True, ("q", None)),) for t in texts] + [(None,)], schema)
    got = [r[0] for r in frame.select(identity.struct_hash(frame, F.col("s")).alias("h")).collect()]
    want = [{"z": t, "a": [1, -2], "n": 1 << 60, "b": True, "o": {"y": "q", "x": None}} for t in texts]
    assert got == [sha(w)[7:] for w in want] + [None]
    floats = spark.createDataFrame([((1e22, "x"),)], "s struct<b:double,a:string>")
    assert floats.select(identity.struct_hash(floats, F.col("s")).alias("h")).first()[0] == sha({"a": "x", "b": 1e22})[7:]
    read = []
    monkeypatch.setattr(identity, "canonical_hash", lambda *_, **__: read.append(1) or F.lit("x"))
    plain = spark.createDataFrame(ROWS, SCHEMA).select("*", F.struct(F.lit("i").alias("identity"), F.lit("k").alias("kind")).alias("evidence"))
    identity.struct_hash(plain, F.col("evidence"))
    assert not read
