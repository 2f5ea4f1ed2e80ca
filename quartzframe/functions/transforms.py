"""Coordinate maps: EXIF orientation, display, corner moves, regions, and lines that make a quad."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from .stats import within

#: For each EXIF orientation which axis gives x and y, and whether each is mirrored (rows 2 to 4 keep the axes, 5 to 8 swap them).
ORIENTATIONS = {1: ("x", False, "y", False), 2: ("x", True, "y", False), 3: ("x", True, "y", True), 4: ("x", False, "y", True), 5: ("y", False, "x", False), 6: ("y", True, "x", False), 7: ("y", True, "x", True), 8: ("y", False, "x", True)}
SIDES = ("top", "right", "bottom", "left")


def oriented(p: Column, orientation: Column, width: Column, height: Column) -> Column:
    """A point of the stored image where it lies once the image is turned upright; null for an unknown orientation."""
    most = {"x": width - 1, "y": height - 1}
    along = lambda axis, mirrored: most[axis] - p[axis] if mirrored else p[axis] * 1
    out = F.lit(None)
    for k, (a, flip_a, b, flip_b) in ORIENTATIONS.items():
        out = F.when(orientation == k, g.point(along(a, flip_a).cast("double"), along(b, flip_b).cast("double"))).otherwise(out)
    return out


def moved(p: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """A whole corner moved, kept inside the image."""
    inside = lambda v, size: within(v, F.lit(0), size - 1).cast("long")
    return F.struct(inside(p["x"] + dx, width).alias("x"), inside(p["y"] + dy, height).alias("y"))


def pixels(q: Column, width: Column, height: Column) -> Column:
    """Corners as pixels: halves go up, and all stay inside the image."""
    return F.transform(q, lambda p: moved(F.struct(F.floor(p["x"] + 0.5).alias("x"), F.floor(p["y"] + 0.5).alias("y")), F.lit(0), F.lit(0), width, height))


def to_display(p: Column, scale: Column, left: Column, top: Column) -> Column:
    """An image point on the display, halves to the even pixel."""
    return F.struct(F.rint(p["x"] * scale + left).cast("long").alias("x"), F.rint(p["y"] * scale + top).cast("long").alias("y"))


def from_display(p: Column, scale: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """The corner that a display point stands for, inside the image."""
    return moved(F.struct(F.rint((p["x"] - left) / scale).alias("x"), F.rint((p["y"] - top) / scale).alias("y")), F.lit(0), F.lit(0), width, height)


def full_size(q: Column, factor_x: Column, factor_y: Column, width: Column, height: Column) -> Column:
    """Corners of an analysis image in the full one."""
    return pixels(g.scaled(q, factor_x, factor_y), width, height)


def corner_regions(width: Column, height: Column, share: float) -> Column:
    """Boxes (x1, y1, x2, y2) at the four corners, clockwise from the top left."""
    w, h = F.floor(width * share), F.floor(height * share)
    box = lambda *v: F.array(*[(F.lit(x) if isinstance(x, int) else x).cast("long") for x in v])
    return F.array(box(0, 0, w, h), box(width - w, 0, width, h), box(width - w, height - h, width, height), box(0, height - h, w, height))


def recombined(edges: dict[str, Column]) -> Column:
    """The quad whose sides lie on one chosen line each (top, right, bottom, left: quads that own them); null if two neighbours are parallel."""
    at = lambda side, i: F.get(edges[side], F.lit(i % 4))
    line = {s: (at(s, k), at(s, k + 1)) for k, s in enumerate(SIDES)}
    corners = [g.line_intersection(*line["top"], *line[s]) for s in ("left", "right")] + [g.line_intersection(*line["bottom"], *line[s]) for s in ("right", "left")]
    whole = corners[0].isNotNull() & corners[1].isNotNull() & corners[2].isNotNull() & corners[3].isNotNull()
    return F.when(whole, F.array(*corners))


def parent_shift(q: Column, edges: dict[str, Column], width: Column, height: Column) -> Column:
    """(least, most): of a corner's distances to those of the two quads that gave its sides, the largest smaller and the
    largest of all, as shares of the diagonal."""
    pairs = [("top", "left"), ("top", "right"), ("right", "bottom"), ("bottom", "left")]
    far = lambda i, s: g.distance(F.get(q, F.lit(i)), F.get(edges[s], F.lit(i))) / g.diagonal(width, height)
    gaps = [(far(i, a), far(i, b)) for i, (a, b) in enumerate(pairs)]
    return F.struct(F.greatest(*[F.least(a, b) for a, b in gaps]).alias("least"), F.greatest(*[x for pair in gaps for x in pair]).alias("most"))


def canonical_segment(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, quality: Column) -> Column:
    """A segment (angle modulo pi, length, offset, low, high): the same whichever end comes first; null if it is short or weak."""
    length = F.hypot(x2 - x1, y2 - y1)
    raw = F.pmod(F.atan2(y2 - y1, x2 - x1), F.lit(math.pi))
    long = (length >= F.greatest(F.lit(6.0), F.hypot(width, height) * 0.035)) & (within(quality, F.lit(0.0), F.lit(1.0)) > 0.02)

    def placed(angle: Column) -> Column:
        along = lambda x, y: x * F.cos(angle) + y * F.sin(angle)
        offset = (y1 + y2) * 0.5 * F.cos(angle) - (x1 + x2) * 0.5 * F.sin(angle)
        return F.struct(angle.alias("angle"), length.alias("length"), offset.alias("offset"), F.least(along(x1, y1), along(x2, y2)).alias("low"), F.greatest(along(x1, y1), along(x2, y2)).alias("high"))

    return F.when(long, g.let(raw, placed))


def segment_order(segment: Column) -> list[Column]:
    """Columns that put canonical segments into a stable order."""
    return [F.round(segment["angle"], 10), *[F.round(segment[c], 6) for c in ("offset", "low", "high")]]
