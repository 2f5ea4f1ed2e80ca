"""One option for each of four edges of a quad, so that their lines meet in a legal quad of least risk."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

# Limits of a legal quad, the margin of an edge with a single option, most options of an edge.
BOUNDS, ANCHOR, AREA, ANGLES, FLAT = 0.065, 0.065, (0.015, 1.05), (15.0, 165.0), 1e-9
ALONE, MOST_OPTIONS = 20.0, 8
#: Groups that are Python objects at once.
AT_ONCE = 64
EDGES = 4

Point = tuple[float, float]


def crossing(a: Point, b: Point, c: Point, d: Point) -> Point | None:
    """Where the lines ab and cd meet."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    area = ux * vy - uy * vx
    if abs(area) <= FLAT * max(math.hypot(ux, uy) * math.hypot(vx, vy), 1.0):
        return None
    t = ((c[0] - a[0]) * vy - (c[1] - a[1]) * vx) / area
    return a[0] + t * ux, a[1] + t * uy


def combined(quads: list[list[Point]]) -> list[Point] | None:
    """Corners where the lines of edge i of quad i meet those of their neighbours, in the quads' order of corners."""
    lines = [(q[i], q[(i + 1) % EDGES]) for i, q in enumerate(quads)]
    found = [crossing(*lines[i], *lines[i - 1]) for i in range(EDGES)]
    return None if None in found else found


def legality(corners: list[Point], anchors: list[list[Point]], width: float, height: float) -> tuple[bool, bool, float]:
    """(legal, legal by both anchors, displacement): whether the quad has the shape, size and place that it may have.

    Each corner must be near that corner of the quad that one of its two edges came from; ``displacement`` is the largest distance so measured.
    """
    diagonal, n = math.hypot(width, height), EDGES
    turns, angles = [], []
    for i in range(n):
        (px, py), (x, y), (qx, qy) = corners[i - 1], corners[i], corners[(i + 1) % n]
        turns.append((x - px) * (qy - y) - (y - py) * (qx - x))
        size = math.hypot(px - x, py - y) * math.hypot(qx - x, qy - y)
        angles.append(math.degrees(math.acos(max(-1.0, min(1.0, ((px - x) * (qx - x) + (py - y) * (qy - y)) / size)))) if size > 1e-12 else 0.0)
    area = abs(sum(corners[i][0] * corners[(i + 1) % n][1] - corners[(i + 1) % n][0] * corners[i][1] for i in range(n))) / (2 * width * height)
    far = BOUNDS * diagonal
    inside = all(-far <= x <= width - 1 + far and -far <= y <= height - 1 + far for x, y in corners)
    shape = (min(turns) > FLAT or max(turns) < -FLAT) and inside and AREA[0] <= area <= AREA[1] and ANGLES[0] <= min(angles) and max(angles) <= ANGLES[1]
    moved = [[math.dist(corners[i], anchors[e][i]) / diagonal for e in (i, i - 1)] for i in range(n)]
    nearest, farthest = max(map(min, moved)), max(map(max, moved))
    return shape and nearest <= ANCHOR, shape and farthest <= ANCHOR, nearest


def best_combination(slots: list[list[dict]], width: float, height: float, objective: str) -> tuple | None:
    """(key, corners, options) of least key among the legal combinations of an option for each edge; none if there is no legal one.

    Combinations come from a heap in the order of the key's first part, the worst risk or their sum, which never falls where an option's place grows.
    The search ends when that part exceeds the best legal one's.
    """
    lead = max if objective == "minimax" else sum
    first = (0,) * EDGES
    heap, seen, best = [(lead(s[0]["risk"] for s in slots), first)], {first}, None
    while heap and (best is None or heap[0][0] <= best[0][0]):
        value, places = heapq.heappop(heap)
        for e in range(EDGES):
            further = (*places[:e], places[e] + 1, *places[e + 1 :])
            if further[e] < len(slots[e]) and further not in seen:
                seen.add(further)
                heapq.heappush(heap, (lead(s[i]["risk"] for s, i in zip(slots, further)), further))
        chosen = [s[i] for s, i in zip(slots, places)]
        corners = combined([o["corners"] for o in chosen])
        if corners is None:
            continue
        legal, both, displacement = legality(corners, [o["anchor"] for o in chosen], width, height)
        if not legal:
            continue
        risks, upper, support, ids = ([o[c] for o in chosen] for c in ("risk", "upper", "support", "option"))
        rest = (max(upper), 0 if both else 1, displacement, -min(support))
        key = (max(risks), *rest, sum(risks), tuple(ids)) if objective == "minimax" else (sum(risks), max(risks), *rest, tuple(ids))
        if best is None or key < best[0]:
            best = (key, corners, chosen)
    return best


def proposals(batches: Iterator[pa.RecordBatch], by: list[str], width: float, height: float, limit: int, objective: str) -> Iterator[pa.RecordBatch]:
    """A row for each group (by, options) that has a proposal.

    An option is some fifty Python objects, so a batch of thousands of groups would take gigabytes: a few are read at a time.
    """
    for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
        rows = []
        for i, found in enumerate(batch.column(len(by)).to_pylist()):
            for o in found:
                o["corners"], o["anchor"] = ([(p["x"], p["y"]) for p in o[c]] for c in ("corners", "anchor"))
            of_edge = [[o for o in found if o["edge"] == e and o["place"] > 0] for e in range(EDGES)]
            now = [[o for o in found if o["edge"] == e and o["place"] == 0] for e in range(EDGES)]
            best = best_combination([s[:limit] for s in of_edge], width, height, objective) if all(of_edge) else None
            fallback = best is None and all(of_edge) and all(now)
            best = best_combination(now, width, height, objective) if fallback else best
            if best:
                _, corners, chosen = best
                risks = [o["risk"] for o in chosen]
                rows.append((i, [o["option"] for o in chosen], corners, max(risks), sum(risks), [s[1]["risk"] - s[0]["risk"] if len(s) > 1 else ALONE for s in of_edge], fallback))
        at = pa.array([r[0] for r in rows], pa.int64())
        types = [pa.list_(pa.string()), pa.list_(pa.list_(pa.float64())), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column(j).take(at) for j in range(len(by))] + [pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(types)], names=[*by, "ids", "corners", "worst", "sum", "margins", "fallback"])


def structured_proposal(options: DataFrame, by: list[str], width: float, height: float, limit: int = 6, objective: str = "minimax") -> DataFrame:
    """Rows (by, ids, corners, worst, sum, margins, fallback) of options (by, edge 0 to 3, option, corners, anchor, risk, upper, support, current).

    ``corners`` and ``anchor`` are arrays of four points (x, y); a null anchor is the corners. The ``limit`` options of least risk of each
    edge are combined; where no combination is legal, the edges' current options are taken, if these are legal. A group that has no legal quad, or
    no option for an edge, has no row. Ranks, margins and limits are found before the shuffle; a group has at most nine options an edge then.
    """
    if objective not in ("minimax", "sum") or not 1 <= limit <= MOST_OPTIONS:
        raise ValueError("objective must be minimax or sum, limit 1 to 8")
    fields = ["option", "corners", "anchor", "risk", "upper", "support"]
    filled = options.withColumn("anchor", F.coalesce("anchor", "corners"))
    order = [F.col("risk"), F.col("option")]
    ranked = top_k(filled, [*by, "edge"], order, max(2, limit), "place")
    current = top_k(filled.where("current"), [*by, "edge"], order, 1, "place").withColumn("place", F.lit(0))
    item = F.struct("edge", "place", *fields)
    groups = ranked.unionByName(current).groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("options"))
    kinds = {f.name: f.dataType for f in groups.schema.fields}
    out = ", ".join([*(f"{c} {kinds[c].simpleString()}" for c in by), "ids array<string>, corners array<array<double>>, worst double, sum double, margins array<double>, fallback boolean"])

    run = lambda batches: proposals(batches, by, width, height, limit, objective)
    return groups.select(*by, "options").mapInArrow(run, out)
