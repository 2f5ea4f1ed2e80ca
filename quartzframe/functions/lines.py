"""Line segments as columns: class, score, corner confidence, and how the corners of a quad look by their angles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from .stats import within


@dataclass(frozen=True)
class LineRules:
    """Degrees within which a line counts as level or upright, and the weights of a score's three parts."""

    level: float = 15.0
    upright: float = 15.0
    proximity: float = 0.4
    length: float = 0.4
    angle: float = 0.2


def classified(line: Column, width: Column, height: Column, p: LineRules = LineRules()) -> Column:
    """Struct (kind, score, angle) of a segment struct<x1,y1,x2,y2> in a region: near an edge, long and straight scores high."""
    x1, y1, x2, y2 = (line[n].cast("double") for n in ("x1", "y1", "x2", "y2"))
    angle = F.when(x1 == x2, F.lit(90.0)).otherwise(F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0)))
    off_level, off_upright = F.least(angle, F.abs(angle - 180)), F.abs(angle - 90)
    kind = F.when(off_level < p.level, "horizontal").when(off_upright < p.upright, "vertical").otherwise("unknown")
    near = lambda middle, size: 1 - F.least(middle, size - middle) / size
    proximity = F.when(kind == "horizontal", near((y1 + y2) / 2, height)).otherwise(near((x1 + x2) / 2, width))
    length = F.hypot(x2 - x1, y2 - y1) / g.diagonal(width, height)
    straight = 1 - F.when(kind == "horizontal", off_level).otherwise(off_upright) / 90
    score = F.when(kind == "unknown", F.lit(0.0)).otherwise(p.proximity * proximity + p.length * length + p.angle * straight)
    return F.struct(kind.alias("kind"), score.alias("score"), angle.alias("angle"))


def corner_confidence(edge_pixels: Column, lines: Column, level_score: Column, upright_score: Column, expansion: Column) -> Column:
    """Confidence of a corner from how much was found around it, less a penalty for a wider search; null where something isn't known."""
    both, one = (level_score + upright_score) / 2 * 0.3, F.greatest(level_score, upright_score) * 0.15
    quality = F.when((level_score > 0) & (upright_score > 0), both).when((level_score > 0) | (upright_score > 0), one).otherwise(0.0)
    total = within(edge_pixels / 3000, F.lit(0.0), F.lit(0.25)) + within(lines / 30, F.lit(0.0), F.lit(0.25)) + quality - expansion * 0.05
    return F.when(lines == 0, F.lit(0.0)).otherwise(within(total, F.lit(0.0), F.lit(1.0)))


def angle_status(q: Column, tolerance: float = 20.0) -> Column:
    """Struct (status, anomalies) of a quad by how many of its angles are right, and which aren't (corners from 0)."""
    # turning_angles begins at the second corner
    angles = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(g.turning_angles(q), F.pmod(i + 3, F.lit(4))))
    good = F.transform(angles, lambda a: F.abs(a - 90) <= tolerance)
    bad = F.array_compact(F.transform(good, lambda ok, i: F.when(~ok, i)))
    gap = F.element_at(bad, 2) - F.element_at(bad, 1)
    status = F.when(F.size(bad) == 0, "all_good").when(F.size(bad) == 1, "one_anomaly").when(F.size(bad) == 2, F.when(gap == 2, "multiple_anomalies").otherwise("opposite_anomaly")).otherwise("uncertain")
    return F.struct(status.alias("status"), bad.alias("anomalies"))


def corners_by_sums(q: Column) -> Column:
    """Corners by extremes of x + y and x - y: top left, top right, bottom right, bottom left; the first of equals."""
    pick = lambda key, best: F.get(q, (F.array_position(F.transform(q, key), best(F.transform(q, key))) - 1).cast("int"))
    total, gap = lambda p: p["x"] + p["y"], lambda p: p["x"] - p["y"]
    return F.array(pick(total, F.array_min), pick(gap, F.array_max), pick(total, F.array_max), pick(gap, F.array_min))


def inset(q: Column, distance: Column, width: Column, height: Column) -> Column:
    """The quad with its sides moved inwards by a distance; null where that collapses or isn't legal."""
    at = lambda i: F.get(q, F.lit(i % 4))
    sign = F.when(g.signed_area(q) > 0, 1.0).otherwise(-1.0)

    def moved(i: int) -> tuple[Column, Column]:
        a, b = at(i), at(i + 1)
        length = g.distance(a, b)
        nx, ny = -(b["y"] - a["y"]) / length * sign * distance, (b["x"] - a["x"]) / length * sign * distance
        return g.point(a["x"] + nx, a["y"] + ny), g.point(b["x"] + nx, b["y"] + ny)

    sides = [moved(i) for i in range(4)]
    inner = F.array(*[g.line_intersection(*sides[i - 1], *sides[i]) for i in range(4)])

    def checked(points: Column) -> Column:
        def clear(i: int) -> Column:
            a, b = at(i), at(i + 1)
            return F.forall(points, lambda p: ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])) * sign / g.distance(a, b) >= distance - 1e-9)

        smaller = F.abs(g.signed_area(points)) < F.abs(g.signed_area(q))
        good = clear(0) & clear(1) & clear(2) & clear(3) & g.is_convex(points) & g.in_bounds(points, width, height) & smaller
        return F.when(good, F.transform(points, lambda p: g.point(F.round(p["x"], 3), F.round(p["y"], 3))))

    legal = g.is_complete(q) & g.is_convex(q)
    return F.when(legal & (distance == 0), q).when(legal & (distance > 0), g.let(inner, checked))
