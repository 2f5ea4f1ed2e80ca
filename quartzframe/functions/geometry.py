"""Quadrilaterals as columns: array<struct<x:double,y:double>>, corners in order around the shape.

Everything is a column expression, so plans stay inside the JVM and nulls follow SQL: an
illegal or incomplete shape gives null from measures and false from predicates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import within

QUAD = "array<struct<x:double,y:double>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(*coordinates: Column) -> Column:
    """A quad of eight coordinates x0, y0, ... x3, y3."""
    return F.array(*[point(coordinates[i], coordinates[i + 1]) for i in range(0, 8, 2)])


def quad_of_array(values: Column, first: int = 1) -> Column:
    """A quad of eight neighbouring elements of a numeric array, from element ``first`` (counted from 1)."""
    return quad(*[F.element_at(values, first + i) for i in range(8)])


def is_complete(q: Column) -> Column:
    """Four points with finite coordinates."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(q) == 4) & ~F.exists(q, lambda p: bad(p["x"]) | bad(p["y"])), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def diagonal(width: Column, height: Column) -> Column:
    return F.hypot(width.cast("double"), height.cast("double"))


def rotated(q: Column, by: int = 1) -> Column:
    """The same ring, begun ``by`` corners later."""
    return F.transform(F.sequence(F.lit(0), F.size(q) - 1), lambda i: F.get(q, (i + by) % F.size(q)))


def edges(q: Column) -> Column:
    """Lengths of the sides, each from a corner to the next."""
    return F.zip_with(q, rotated(q), distance)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(q: Column) -> Column:
    """Shoelace area; positive when the corners run clockwise on a screen."""
    return total(F.zip_with(q, rotated(q), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def area_ratio(q: Column, width: Column, height: Column) -> Column:
    return F.abs(signed_area(q)) / (width * height)


def shortest_edge_ratio(q: Column, width: Column, height: Column) -> Column:
    return F.array_min(edges(q)) / diagonal(width, height)


def _steps(q: Column, begin: int) -> Column:
    """The side vectors from each corner to the next."""
    return F.zip_with(rotated(q, begin), rotated(q, begin + 1), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))


def turns(q: Column) -> Column:
    """Cross product of each side and the following one."""
    return F.zip_with(_steps(q, 0), _steps(q, 1), lambda u, v: u["x"] * v["y"] - u["y"] * v["x"])


def is_convex(q: Column) -> Column:
    """All turns in one direction and none flat."""
    t = turns(q)
    return F.coalesce(F.forall(t, lambda v: v > 0) | F.forall(t, lambda v: v < 0), F.lit(False))


def has_duplicate_points(q: Column) -> Column:
    return F.size(F.array_distinct(q)) < F.size(q)


def in_bounds(q: Column, width: Column, height: Column) -> Column:
    return F.forall(q, lambda p: p["x"].between(F.lit(0), width - 1) & p["y"].between(F.lit(0), height - 1))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the open segments ab and cd cross."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def is_self_crossing(q: Column) -> Column:
    at = lambda i: F.get(q, F.lit(i))
    return segments_cross(at(0), at(1), at(2), at(3)) | segments_cross(at(1), at(2), at(3), at(0))


def reject_reason(q: Column, width: Column, height: Column, min_area: float = 0.015, max_area: float = 0.995, min_edge: float = 0.03, max_edge: float = 1.5) -> Column:
    """The first reason against a quad, or null for a legal one."""
    longest = F.array_max(edges(q)) / diagonal(width, height)
    return (
        F.when(q.isNull(), "missing_corners")
        .when(~is_complete(q), "non_finite_geometry")
        .when(has_duplicate_points(q), "duplicate_points")
        .when(is_self_crossing(q), "self_intersecting")
        .when(~is_convex(q), "non_convex_geometry")
        .when(~in_bounds(q, width, height), "invalid_geometry")
        .when(~area_ratio(q, width, height).between(min_area, max_area), "area_out_of_bounds")
        .when((shortest_edge_ratio(q, width, height) < min_edge) | (longest > max_edge), "edge_length_out_of_bounds")
    )


def is_legal(q: Column, width: Column, height: Column, **limits: float) -> Column:
    return reject_reason(q, width, height, **limits).isNull()


def ordered(q: Column) -> Column:
    """Corners by angle around their centre, begun at the one with the least x + y: top left, top right, bottom right, bottom left."""
    n = F.size(q)
    cx, cy = total(F.transform(q, lambda p: p["x"])) / n, total(F.transform(q, lambda p: p["y"])) / n
    keyed = F.array_sort(F.transform(q, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("k"), p["x"].alias("x"), p["y"].alias("y"))))
    ring = F.transform(keyed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    sums = F.transform(ring, lambda p: p["x"] + p["y"])
    begin = F.array_position(sums, F.array_min(sums)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, (i + begin) % n))


def corner_distances(a: Column, b: Column) -> Column:
    """Distance of each corner of ``a`` from that of ``b``; null unless both are complete."""
    return F.when(is_complete(a) & is_complete(b), F.zip_with(a, b, distance))


def mean_corner_distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    d = corner_distances(a, b)
    return total(d) / F.size(d) / diagonal(width, height)


def max_corner_distance(a: Column, b: Column, width: Column, height: Column) -> Column:
    return F.array_max(corner_distances(a, b)) / diagonal(width, height)


def is_strict(a: Column, truth: Column, width: Column, height: Column, limit: float = 0.005) -> Column:
    return F.coalesce(max_corner_distance(a, truth, width, height) <= limit, F.lit(False))


def jitter_threshold(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(2.0), diagonal(width, height) * 0.0005)


def moved_corners(a: Column, b: Column, width: Column, height: Column) -> Column:
    d = corner_distances(a, b)
    return F.coalesce(F.size(F.filter(d, lambda v: v > jitter_threshold(width, height))), F.lit(0))


def all_within(a: Column, b: Column, tolerance: float = 2.0) -> Column:
    return F.coalesce(F.forall(corner_distances(a, b), lambda v: v <= tolerance), F.lit(False))


def line_intersection(a: Column, b: Column, c: Column, d: Column, tolerance: float = 1e-9) -> Column:
    """Where the lines ab and cd meet; null when they are parallel."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    cross = ux * vy - uy * vx
    t = ((c["x"] - a["x"]) * vy - (c["y"] - a["y"]) * vx) / F.nullif(cross, F.lit(0.0))
    return F.when(F.abs(cross) > tolerance, point(a["x"] + t * ux, a["y"] + t * uy))


def point_line_distance(p: Column, a: Column, b: Column) -> Column:
    length = distance(a, b)
    return F.abs((b["x"] - a["x"]) * (a["y"] - p["y"]) - (a["x"] - p["x"]) * (b["y"] - a["y"])) / F.nullif(length, F.lit(0.0))


def edge_line_errors(q: Column, truth: Column, width: Column, height: Column) -> Column:
    """For each side the largest distance of either shape's ends from the other's line, as a share of the diagonal."""

    def side(i: int) -> Column:
        a, b, c, d = (F.get(s, F.lit(k % 4)) for s, k in ((q, i), (q, i + 1), (truth, i), (truth, i + 1)))
        return F.greatest(point_line_distance(a, c, d), point_line_distance(b, c, d), point_line_distance(c, a, b), point_line_distance(d, a, b)) / diagonal(width, height)

    return F.array(*[side(i) for i in range(4)])


def scaled(q: Column, fx: Column, fy: Column) -> Column:
    return F.transform(q, lambda p: point(p["x"] * fx, p["y"] * fy))


def homography(q: Column, m: list[list[float]]) -> Column:
    """Projective map by a 3 x 3 matrix; null where a point goes to infinity."""

    def move(p: Column) -> Column:
        row = lambda r: p["x"] * m[r][0] + p["y"] * m[r][1] + m[r][2]
        w = F.nullif(row(2), F.lit(0.0))
        return F.when(F.abs(row(2)) > 1e-12, point(row(0) / w, row(1) / w))

    moved = F.transform(q, move)
    return F.when(F.forall(moved, lambda p: p.isNotNull()), moved)


def clamped(p: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    lim = lambda v, n: within(v, F.lit(margin), n - 1 - margin)
    return point(lim(p["x"], width), lim(p["y"], height))


def overshoot(p: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """How far a point lies outside: the shares of the width and of the height, added."""
    over = lambda v, n: F.greatest(F.lit(0.0), F.lit(margin) - v, v - (n - 1 - margin))
    return over(p["x"], width) / width + over(p["y"], height) / height


def missing_corner(q: Column, index: int) -> Column:
    """The corner that completes a parallelogram."""
    at = lambda i: F.get(q, F.lit(i % 4))
    a, b, c = at(index + 1), at(index + 2), at(index + 3)
    return point(a["x"] + c["x"] - b["x"], a["y"] + c["y"] - b["y"])


def turning_angles(q: Column) -> Column:
    """Degrees between the sides that follow one another."""

    def angle(a: Column, b: Column) -> Column:
        cosine = (a["x"] * b["x"] + a["y"] * b["y"]) / F.nullif(F.hypot(a["x"], a["y"]) * F.hypot(b["x"], b["y"]), F.lit(0.0))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    return F.zip_with(_steps(q, 0), _steps(q, 1), angle)


def right_angles(q: Column, tolerance: float = 10.0) -> Column:
    """How many of the angles are right within a tolerance in degrees."""
    return F.size(F.filter(turning_angles(q), lambda d: F.abs(d - 90) <= tolerance))


def output_size(q: Column) -> Column:
    """Width and height of the upright picture of a quad: the longer of each two opposite sides."""
    at = lambda i: F.get(edges(q), F.lit(i))
    return F.struct(F.greatest(at(0), at(2)).alias("width"), F.greatest(at(1), at(3)).alias("height"))
