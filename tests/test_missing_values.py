"""Values that are missing stay missing where a measure is held between bounds."""

from pyspark.sql import functions as F

from quartzframe.functions import geometry as g
from quartzframe.functions import lines, stats, transforms
from quartzframe.operators import staged

L = F.lit


def test_bounds_do_not_replace_a_missing_value(spark):
    none = L(None).cast("double")
    half = L(0.5)
    [got] = spark.range(1).select(
        stats.within(none, L(0.0), L(1.0)).alias("within"),
        stats.logistic(none).alias("logistic"),
        stats.logistic(L(0.0)).alias("even"),
        g.clamped(g.point(none, L(7.0)), L(10), L(10)).alias("clamped"),
        transforms.moved(g.point(none, L(3.0)), L(1), L(99), L(20), L(20)).alias("moved"),
        lines.corner_confidence(none, L(3), half, half, L(0.0)).alias("no_pixels"),
        lines.corner_confidence(L(3000.0), L(30), none, half, L(0.0)).alias("no_level"),
        lines.corner_confidence(L(3000.0), L(30), half, half, L(0.0)).alias("known"),
        transforms.canonical_segment(L(0.0), L(0.0), L(50.0), L(0.0), L(100), L(100), none).alias("no_quality"),
        transforms.canonical_segment(L(0.0), L(0.0), L(50.0), L(0.0), L(100), L(100), half).alias("quality"),
    ).collect()
    assert [got[n] for n in ("within", "logistic", "no_pixels", "no_quality")] == [None] * 4
    assert got["even"] == 0.5 and got["known"] == 0.65 and got["quality"]["length"] == 50.0
    assert tuple(got["clamped"]) == (None, 7.0) and tuple(got["moved"]) == (None, 19)
    assert got["no_level"] == 0.575


def test_a_candidate_without_a_score_has_no_margin(spark):
    rows = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5), ("a", "z", None)], "image string, candidate string, score double")
    got = {r["candidate"]: r["margin"] for r in staged.margins(rows, ["image"], "candidate", "score").collect()}
    assert got == {"x": 1.0, "y": 0.0, "z": None}
