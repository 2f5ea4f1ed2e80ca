"""Corners of a quad that were found with little confidence, put right from the other three."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g

#: Confidence of a good corner, shares that inferred corners keep of it, how far outside they may be, the most that costs, and angles of an upright quad.
GOOD, BY_EDGES, BY_DIAGONAL, OUTSIDE, PENALTY, UPRIGHT = 0.6, 0.95, 0.9, 0.1, 0.3, (60.0, 120.0)
CORNERS = range(4)


def whole(p: Column) -> Column:
    """The point with its fractions cut off."""
    return g.point(*[F.when(p[a] < 0, F.ceil(p[a])).otherwise(F.floor(p[a])).cast("double") for a in ("x", "y")])


def placed(p: Column, width: Column, height: Column) -> Column:
    """The nearest whole point of the picture."""
    return whole(g.clamped(p, width, height))


def _good(confidences: Column, i: int, least: float) -> Column:
    return F.coalesce(F.get(confidences, F.lit(i % 4)) > least, F.lit(False))


def _option(q: Column, confidences: Column, target: int, order: list[int], width: Column, height: Column, share: float, cut: bool) -> Column:
    """Struct (index, corner, confidence) of a corner as the others give it; null if that is too far outside."""
    first, second, third = (F.get(confidences, F.lit(i)) for i in order)

    def scored(p: Column) -> Column:
        far = g.overshoot(p, width, height)
        kept = F.when(far > 0, 1 - F.least(far * 2, F.lit(PENALTY))).otherwise(1.0)
        return F.when(far <= OUTSIDE, F.struct(F.lit(target).alias("index"), placed(p, width, height).alias("corner"), ((first + second + third) / 3 * share * kept).alias("confidence")))

    corner = g.missing_corner(q, target)
    return g.let(whole(corner) if cut else corner, scored)


def from_two_edges(q: Column, confidences: Column, width: Column, height: Column, least: float = GOOD) -> Column:
    """Struct (index, corner, confidence) of the corner that two good edges with a common corner leave; null without such edges.

    Pairs of edges are tried in the order of their numbers, and the first whose fourth corner isn't far outside counts, whether or not that corner is good itself.
    """
    options = []
    for target in (3, 2, 0, 1):  # what the pairs of edges 01, 03, 12 and 23 leave
        known = [i for i in CORNERS if i != target]
        good = _good(confidences, known[0], least) & _good(confidences, known[1], least) & _good(confidences, known[2], least)
        options.append(F.when(good, _option(q, confidences, target, known, width, height, BY_EDGES, cut=False)))
    return F.coalesce(*options)


def from_diagonal(q: Column, confidences: Column, width: Column, height: Column, least: float = GOOD) -> Column:
    """Struct (index, corner, confidence) of the one corner that isn't good, from a good edge and the corner opposite; null if there is no such corner."""
    options = []
    for target in CORNERS:
        known = [(target + i) % 4 for i in (1, 2, 3)]
        good = _good(confidences, known[0], least) & _good(confidences, known[1], least) & _good(confidences, known[2], least)
        options.append(F.when(good & ~_good(confidences, target, least), _option(q, confidences, target, known, width, height, BY_DIAGONAL, cut=True)))
    return F.coalesce(*options)


def is_upright(q: Column) -> Column:
    low, high = UPRIGHT
    return F.coalesce(F.forall(g.turning_angles(q), lambda a: (a > low) & (a < high)), F.lit(False))


def completed(q: Column, confidences: Column, width: Column, height: Column, least: float = GOOD) -> Column:
    """Struct (corners, confidences, how) of a quad whose doubtful corner is inferred.

    Two good edges are tried first, then, if the quad isn't upright after that, an edge and a diagonal; an inferred corner counts
    if its confidence is higher. ``how`` is found (all are good), edges, diagonal, unchecked (by edges, not upright) or none. Corners
    are whole points of the picture. Null or incomplete quads, and other numbers of confidences than four, give null.
    """
    state = lambda corners, trust, how: F.struct(corners.alias("corners"), trust.alias("confidences"), F.lit(how).alias("how"))

    def tried(s: Column, infer, how: str) -> Column:
        def put(o: Column) -> Column:
            better = F.coalesce(o["confidence"] > F.get(s["confidences"], o["index"]), F.lit(False))
            at = lambda value: lambda v, i: F.when(i == o["index"], value).otherwise(v)
            return F.when(better, state(F.transform(s["corners"], at(o["corner"])), F.transform(s["confidences"], at(o["confidence"])), how)).otherwise(s)

        return g.let(infer(s["corners"], s["confidences"], width, height, least), put)

    def by_diagonal(s: Column) -> Column:
        done = (s["how"] == "edges") & is_upright(s["corners"])
        open_ = F.struct(s["corners"].alias("corners"), s["confidences"].alias("confidences"), F.when(s["how"] == "edges", "unchecked").otherwise(s["how"]).alias("how"))
        return F.when(done, s).otherwise(g.let(open_, lambda o: tried(o, from_diagonal, "diagonal")))

    def end(s: Column) -> Column:
        return F.struct(F.transform(s["corners"], lambda p: placed(p, width, height)).alias("corners"), s["confidences"].alias("confidences"), s["how"].alias("how"))

    points = F.transform(q, lambda p: g.point(p["x"].cast("double"), p["y"].cast("double")))
    trust = confidences.cast("array<double>")
    every = F.forall(trust, lambda v: F.coalesce(v > least, F.lit(False)))
    start = g.let(state(points, trust, "none"), lambda s: g.let(tried(s, from_two_edges, "edges"), by_diagonal))
    return F.when(g.is_complete(q) & (F.size(confidences) == 4), g.let(F.when(every, state(points, trust, "found")).otherwise(start), end))
