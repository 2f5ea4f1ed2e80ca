"""Registered queries of robust fits, staged scores and structured proposals, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import robust, staged, structured
from .queries import register, table

C = F.col


def _line_rounds(n: int) -> str:
    """SQL of the rounds of a robust fit over p (k, x, y, w)."""
    parts = ["l0 AS (SELECT k, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, NULL::DOUBLE AS s FROM p GROUP BY k HAVING count(*) > 1)"]
    for i in range(n):
        far = "abs((x - ax) * dy - (y - ay) * dx)"
        parts += [
            f"w{i} AS (SELECT p.k, x, y, w * CASE WHEN {far} > 1.5 * s THEN 1.5 * s / {far} ELSE 1 END AS w FROM p JOIN l{i} USING (k))",
            f"c{i} AS (SELECT k, sum(w * x) / sum(w) AS ax, sum(w * y) / sum(w) AS ay FROM w{i} GROUP BY k)",
            f"v{i} AS (SELECT k, ax, ay, atan2(2 * sum(w * (x - ax) * (y - ay)), sum(w * (x - ax) * (x - ax)) - sum(w * (y - ay) * (y - ay))) / 2 AS t FROM w{i} JOIN c{i} USING (k) GROUP BY k, ax, ay)",
            f"d{i} AS (SELECT k, ax, ay, CASE WHEN cos(t) + sin(t) < 0 THEN -cos(t) ELSE cos(t) END AS dx, CASE WHEN cos(t) + sin(t) < 0 THEN -sin(t) ELSE sin(t) END AS dy FROM v{i})",
            f"l{i + 1} AS (SELECT k, ax, ay, dx, dy, greatest(0.25, 1.4826 * median({far})) AS s FROM p JOIN d{i} USING (k) GROUP BY k, ax, ay, dx, dy)",
        ]
    return ", ".join(parts)


@register(
    "robust_lines",
    f"""WITH p AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS x, l_extendedprice / 1000 + CASE WHEN l_orderkey % 17 = 0 THEN 50 ELSE 0 END AS y, 1 + l_discount AS w FROM lineitem), {_line_rounds(3)}
    SELECT k AS l_suppkey, round(ax, 6) AS ax, round(ay, 6) AS ay, round(dx, 6) AS dx, round(dy, 6) AS dy, round(s, 6) AS scale FROM l3""",
)
def robust_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    points = rows.select("l_suppkey", C("l_quantity").cast("double").alias("x"), (C("l_extendedprice") / 1000 + F.when(C("l_orderkey") % 17 == 0, 50).otherwise(0)).alias("y"), (1 + C("l_discount")).alias("w"))
    ways = rows.select("l_suppkey").distinct().select("l_suppkey", F.lit(1.0).alias("dx"), F.lit(1.0).alias("dy"))
    found = robust.robust_lines(points, ["l_suppkey"], "x", "y", "w", ways)
    return found.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("ax", "ay", "dx", "dy", "scale")])


@register(
    "two_stage_scores",
    """WITH s AS (SELECT p_brand, p_partkey, p_size, p_retailprice / 2500 AS s FROM part),
    m AS (SELECT *, 0.9::DOUBLE * s + 0.1::DOUBLE * greatest(0, least(1, 0.5 + (s - coalesce((SELECT max(o.s) FROM s o WHERE o.p_brand = s.p_brand AND o.p_partkey <> s.p_partkey), 0)) * 5))::DOUBLE AS pre_score FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pre_score DESC, p_partkey) AS pre_rank FROM m)
    SELECT p_brand, p_partkey, pre_score, pre_rank::INTEGER AS pre_rank, CASE WHEN pre_rank <= 4 THEN pre_rank ELSE 0 END::INTEGER AS selected_rank, CASE WHEN pre_rank <= 4 THEN pre_score + p_size / 100.0::DOUBLE ELSE pre_score END AS score, CASE WHEN pre_rank > 4 THEN 'topk_limit' END AS reason FROM r""",
)
def two_stage_scores(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", (C("p_retailprice") / 2500).alias("s"))
    full = lambda df: df.withColumn("full_score", C("pre_score") + C("p_size") / 100)
    return staged.two_stage(parts, ["p_brand"], "p_partkey", "s", lambda margin: 0.9 * C("s") + 0.1 * margin, full, 4).na.fill(0, ["selected_rank"])


def _combinations(rows: str, places: str) -> str:
    """SELECT of all legal combinations of ``rows`` (u, edge, id, risk, upper, support, px, py, ux, uy, x0 to y3)."""
    cross = lambda i, j, v: f"(e{i}.p{v} + ((e{j}.px - e{i}.px) * e{j}.uy - (e{j}.py - e{i}.py) * e{j}.ux) / (e{i}.ux * e{j}.uy - e{i}.uy * e{j}.ux) * e{i}.u{v})"
    flat = " AND ".join(f"abs(e{i}.ux * e{j}.uy - e{i}.uy * e{j}.ux) > 1e-9 * greatest(sqrt(e{i}.ux * e{i}.ux + e{i}.uy * e{i}.uy) * sqrt(e{j}.ux * e{j}.ux + e{j}.uy * e{j}.uy), 1)" for i, j in ((0, 3), (1, 0), (2, 1), (3, 2)))
    corners = ", ".join(f"{cross(i, (i - 1) % 4, v)} AS {v}{i}" for i in range(4) for v in "xy")
    joins = " ".join(f"JOIN {rows} e{i} ON e{i}.u = e0.u AND e{i}.edge = {i} AND e{i}.{places}" for i in (1, 2, 3))
    anchors = ", ".join(f"e{i}.{v}{c} AS a{v}{i}_{c}" for i in range(4) for c in (i, (i + 1) % 4) for v in "xy")
    made = f"SELECT e0.u, greatest(e0.risk, e1.risk, e2.risk, e3.risk) AS worst, greatest(e0.upper, e1.upper, e2.upper, e3.upper) AS upper, least(e0.support, e1.support, e2.support, e3.support) AS support, e0.risk + e1.risk + e2.risk + e3.risk AS total, concat_ws(',', e0.id, e1.id, e2.id, e3.id) AS ids, {corners}, {anchors} FROM {rows} e0 {joins} WHERE e0.edge = 0 AND e0.{places} AND {flat}"
    turn = lambda i: f"(x{i} - x{(i - 1) % 4}) * (y{(i + 1) % 4} - y{i}) - (y{i} - y{(i - 1) % 4}) * (x{(i + 1) % 4} - x{i})"
    turns = ", ".join(turn(i) for i in range(4))
    side = lambda i, j: f"sqrt((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}))"
    angles = ", ".join(f"degrees(acos(greatest(-1, least(1, ((x{(i - 1) % 4} - x{i}) * (x{(i + 1) % 4} - x{i}) + (y{(i - 1) % 4} - y{i}) * (y{(i + 1) % 4} - y{i})) / ({side(i, (i - 1) % 4)} * {side(i, (i + 1) % 4)})))))" for i in range(4))
    area = "abs(" + " + ".join(f"x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i}" for i in range(4)) + ") / (2 * 1000 * 800)"
    far = "0.065 * sqrt(1000 * 1000 + 800 * 800)"
    inside = " AND ".join(f"x{i} BETWEEN -{far} AND 999 + {far} AND y{i} BETWEEN -{far} AND 799 + {far}" for i in range(4))
    gap = lambda i, e: f"sqrt((x{i} - ax{e}_{i}) * (x{i} - ax{e}_{i}) + (y{i} - ay{e}_{i}) * (y{i} - ay{e}_{i})) / sqrt(1000 * 1000 + 800 * 800)"
    near = ", ".join(f"least({gap(i, i)}, {gap(i, (i - 1) % 4)})" for i in range(4))
    most = ", ".join(gap(i, e) for i in range(4) for e in (i, (i - 1) % 4))
    return f"SELECT u, worst, upper, CASE WHEN greatest({most}) <= 0.065 THEN 0 ELSE 1 END AS both_far, greatest({near}) AS moved, support, total, ids FROM ({made}) WHERE (least({turns}) > 1e-9 OR greatest({turns}) < -1e-9) AND {inside} AND {area} BETWEEN 0.015 AND 1.05 AND least({angles}) >= 15 AND greatest({angles}) <= 165 AND greatest({near}) <= 0.065"


#: Options from events: corners around those of one quad; those of every third event are turned by one corner and have little risk.
OPTION_SQL = "q AS (SELECT user_id AS u, event_id AS n, event_id % 4 AS edge, lpad(event_id::VARCHAR, 12, '0') AS id, CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 1 END * ((event_id * 7919 % 1000) / 1000.0::DOUBLE)::DOUBLE AS risk, (event_id % 5)::DOUBLE AS support, event_id % 9 = 0 AS now, " + ", ".join(
    f"({b} + (event_id * {k} % 60) - 30)::DOUBLE AS {n}" for n, b, k in (("x0", 100, 37), ("y0", 100, 53), ("x1", 900, 41), ("y1", 100, 59), ("x2", 900, 43), ("y2", 700, 61), ("x3", 100, 47), ("y3", 700, 67))
) + " FROM events), " + (
    "o AS (SELECT u, n, edge, id, risk, risk + (n % 7) / 10.0::DOUBLE AS upper, support, now, " + ", ".join(f"CASE WHEN n % 3 = 0 THEN {v}{(i + 1) % 4} ELSE {v}{i} END AS {v}{i}" for i in range(4) for v in "xy") + " FROM q), "
    "p AS (SELECT *, CASE edge " + " ".join(f"WHEN {i} THEN x{i}" for i in range(4)) + " END AS px, CASE edge " + " ".join(f"WHEN {i} THEN y{i}" for i in range(4)) + " END AS py, CASE edge " + " ".join(f"WHEN {i} THEN x{(i + 1) % 4} - x{i}" for i in range(4)) + " END AS ux, CASE edge " + " ".join(f"WHEN {i} THEN y{(i + 1) % 4} - y{i}" for i in range(4)) + " END AS uy, "
    "row_number() OVER (PARTITION BY u, edge ORDER BY risk, id) AS place, CASE WHEN now THEN row_number() OVER (PARTITION BY u, edge, now ORDER BY risk, id) END AS turn FROM o), "
    "r AS (SELECT *, place <= 6 AS chosen, coalesce(turn = 1, false) AS current FROM p)"
)


def proposal_sql(order: str) -> str:
    return f"""WITH {OPTION_SQL}, a AS ({_combinations("r", "chosen")}), b AS ({_combinations("r", "current")}),
    four AS (SELECT u FROM r GROUP BY u HAVING count(DISTINCT edge) = 4),
    full_a AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY {order}) AS k FROM a), full_b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY {order}) AS k FROM b WHERE u NOT IN (SELECT u FROM a) AND u IN (SELECT u FROM four)),
    f AS (SELECT u, ids, worst, false AS fallback FROM full_a WHERE k = 1 UNION ALL SELECT u, ids, worst, true FROM full_b WHERE k = 1),
    m AS (SELECT u, coalesce(max(risk) FILTER (place = 2) - max(risk) FILTER (place = 1), 20) AS margin FROM r WHERE edge = 0 GROUP BY u)
    SELECT u AS user_id, ids, worst, fallback, margin FROM f JOIN m USING (u)"""


def _proposals(spark: SparkSession, d: str, objective: str) -> DataFrame:
    n = C("event_id")
    base = {"x0": (100, 37), "y0": (100, 53), "x1": (900, 41), "y1": (100, 59), "x2": (900, 43), "y2": (700, 61), "x3": (100, 47), "y3": (700, 67)}
    at = {k: (b + n * m % 60 - 30).cast("double") for k, (b, m) in base.items()}
    points = [g.point(at[f"x{i}"], at[f"y{i}"]) for i in range(4)]
    corners = F.when(n % 3 == 0, F.array(*points[1:], points[0])).otherwise(F.array(*points))
    risk = F.when(n % 3 == 0, 0.25).otherwise(1.0) * (n * 7919 % 1000 / 1000)
    options = table(spark, d, "events").select("user_id", (n % 4).cast("int").alias("edge"), F.lpad(n.cast("string"), 12, "0").alias("option"), corners.alias("corners"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("anchor"), risk.alias("risk"), (risk + n % 7 / 10).alias("upper"), (n % 5).cast("double").alias("support"), (n % 9 == 0).alias("current"))
    found = structured.structured_proposal(options, ["user_id"], 1000.0, 800.0, 6, objective)
    return found.select("user_id", F.array_join("ids", ",").alias("ids"), "worst", "fallback", C("margins")[0].alias("margin"))


@register("structured_minimax", proposal_sql("worst, upper, both_far, moved, -support, total, ids"))
def structured_minimax(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d, "minimax")


@register("structured_sum", proposal_sql("round(total, 12), worst, upper, both_far, moved, -support, ids"))
def structured_sum(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d, "sum")
