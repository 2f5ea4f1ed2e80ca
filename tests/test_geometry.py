import math

import pytest
from pyspark.sql import functions as F

from quartzframe.functions import geometry as g
from quartzframe.images import kernels

SQUARE = [(10.0, 10.0), (110.0, 10.0), (110.0, 70.0), (10.0, 70.0)]


def rows(spark, *quads):
    return spark.createDataFrame([(i, None if q is None else [{"x": float(x), "y": float(y)} for x, y in q]) for i, q in enumerate(quads)], f"i int, q {g.QUAD}")


def one(spark, q, column):
    return rows(spark, q).select(column.alias("v")).first()["v"]


def test_area_edges_and_order(spark):
    q = F.col("q")
    assert one(spark, SQUARE, g.signed_area(q)) == 6000
    assert one(spark, SQUARE, g.edges(q)) == [100, 60, 100, 60]
    mixed = [SQUARE[2], SQUARE[0], SQUARE[3], SQUARE[1]]
    assert [tuple(p) for p in one(spark, mixed, g.ordered(q))] == SQUARE
    assert one(spark, SQUARE, g.turning_angles(q)) == pytest.approx([90] * 4)


@pytest.mark.parametrize(
    "quad,reason",
    [
        (SQUARE, None),
        (None, "missing_corners"),
        ([(0, 0), (0, 0), (5, 5), (0, 5)], "duplicate_points"),
        ([(0, 0), (100, 70), (100, 0), (0, 70)], "self_intersecting"),
        ([(0, 0), (100, 0), (20, 20), (0, 70)], "non_convex_geometry"),
        ([(0, 0), (2, 0), (2, 2), (0, 2)], "area_out_of_bounds"),
        ([(0, 0), (float("nan"), 0), (9, 9), (0, 9)], "non_finite_geometry"),
        ([(-9, 0), (100, 0), (100, 70), (0, 70)], "invalid_geometry"),
    ],
)
def test_first_reason_against_a_quad(spark, quad, reason):
    assert one(spark, quad, g.reject_reason(F.col("q"), F.lit(120.0), F.lit(80.0))) == reason


def test_distances_and_lines(spark):
    moved = [(x + 3, y + 4) for x, y in SQUARE]
    df = rows(spark, SQUARE).join(rows(spark, moved).withColumnRenamed("q", "t"), "i")
    w, h = F.lit(300.0), F.lit(400.0)
    got = df.select(g.mean_corner_distance(F.col("q"), F.col("t"), w, h).alias("mean"), g.max_corner_distance(F.col("q"), F.col("t"), w, h).alias("most"), g.is_strict(F.col("q"), F.col("t"), w, h).alias("strict"), g.moved_corners(F.col("q"), F.col("t"), w, h).alias("moved")).first()
    assert (got["mean"], got["most"], got["strict"], got["moved"]) == (0.01, 0.01, False, 4)
    at = lambda i: F.get("q", F.lit(i))
    assert tuple(one(spark, SQUARE, g.line_intersection(at(0), at(2), at(1), at(3)))) == (60, 40)
    assert one(spark, SQUARE, g.line_intersection(at(0), at(1), at(3), at(2))) is None
    assert tuple(one(spark, SQUARE, g.missing_corner(F.col("q"), 0))) == SQUARE[0]


def test_polygon_iou():
    a, b = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 0), (3, 0), (3, 2), (1, 2)]
    assert math.isclose(kernels.polygon_iou(a, b), 1 / 3)
    assert kernels.polygon_iou(a, [(5, 5), (6, 5), (6, 6), (5, 6)]) == 0


def test_lines_and_insets(spark):
    from quartzframe.functions import lines as ln

    q = F.col("q")
    inner = one(spark, SQUARE, ln.inset(q, F.lit(5.0), F.lit(200.0), F.lit(100.0)))
    assert [tuple(p) for p in inner] == [(15, 15), (105, 15), (105, 65), (15, 65)]
    assert [tuple(p) for p in one(spark, SQUARE[::-1], ln.inset(q, F.lit(5.0), F.lit(200.0), F.lit(100.0)))] == [(15, 65), (105, 65), (105, 15), (15, 15)]
    assert one(spark, SQUARE, ln.inset(q, F.lit(31.0), F.lit(200.0), F.lit(100.0))) is None
    assert [tuple(p) for p in one(spark, [SQUARE[2], SQUARE[0], SQUARE[3], SQUARE[1]], ln.corners_by_sums(q))] == SQUARE
    assert tuple(one(spark, SQUARE, ln.angle_status(q))) == ("all_good", [])
    bent = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (60.0, 60.0)]
    assert one(spark, bent, ln.angle_status(q))["status"] in ("uncertain", "multiple_anomalies", "opposite_anomaly")
    line = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0, 1, 100, 1))])
    kind, score, angle = spark.range(1).select(ln.classified(line, F.lit(100.0), F.lit(50.0)).alias("v")).first()["v"]
    assert (kind, angle) == ("horizontal", 0.0) and 0.9 < score < 1


def test_validation(spark):
    from quartzframe.operators import validation as v

    rows = spark.createDataFrame([(1, "succeeded", "out.jpg", None), (2, "succeeded", None, None), (3, "failed", None, "boom"), (4, "failed", "x", "boom")], "i int, status string, output_path string, error string")
    full = rows.selectExpr("*", "1 AS schema_version", "'e' AS event_id", "'e' AS crop_id", "'i' AS image_id", "'a' AS annotation_id", "array(array(0,0),array(1,0),array(1,1),array(0,1)) AS boundary_corners", "array(array(0D,0D),array(1D,0D),array(1D,1D),array(0D,1D)) AS crop_corners", "named_struct('method','parallel_edge_offset','distance_px',0D) AS inset", "'2024-01-01T00:00:00Z' AS created_at")
    good, bad = v.split_valid(full, v.crop_rules())
    assert sorted(r["i"] for r in good.collect()) == [1, 3] and {r["i"]: r["reason"] for r in bad.collect()} == {2: "outcome", 4: "outcome"}
    with pytest.raises(Exception, match="invalid record: outcome"):
        v.require(full, v.crop_rules()).collect()
