"""Registered queries of candidates' evidence, coordinate maps and selections, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as e
from ..functions import geometry as g
from ..functions import transforms as t
from ..operators import selection as sel
from .queries import QUAD_SQL, _quads, register, table

C = F.col
#: Parts between 0 and 1 from a line item, and the same in SQL.
PARTS = {"a": "l_discount * 10", "b": "l_tax * 10", "c": "l_quantity / 50", "d": "l_extendedprice / 120000", "e": "(l_orderkey % 101) / 100.0D", "f": "(l_partkey % 97) / 96.0D", "g": "(l_suppkey % 11) / 10.0D", "h": "l_linenumber / 8.0D"}
_SQL_PARTS = ", ".join(f"({v.replace('0D', '0::DOUBLE')})::DOUBLE AS {k}" for k, v in PARTS.items())
ITEMS = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SQL_PARTS} FROM lineitem)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.expr(v).cast("double").alias(k) for k, v in PARTS.items()])


def by_item(value: Column, name: str, places: int = 7) -> list[Column]:
    return [C("l_orderkey"), C("l_linenumber"), F.round(value, places).alias(name)]


def unit_sql(x: str, default: str = "0.0") -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce({x}, {default})))"


@register("edge_support", f"SELECT l_orderkey, round(avg({unit_sql('a')} * 0.5::DOUBLE + {unit_sql('b')} * 0.25::DOUBLE + {unit_sql('c')} * 0.25::DOUBLE), 7) AS score FROM {ITEMS} GROUP BY 1")
def edge_support(spark: SparkSession, d: str) -> DataFrame:
    edges = F.array_sort(F.collect_list(F.struct("l_linenumber", C("a").alias("support"), C("b").alias("direction"), C("c").alias("gradient"))))
    return items(spark, d).groupBy("l_orderkey").agg(edges.alias("edges")).select("l_orderkey", F.round(e.edge_support(C("edges")), 7).alias("score"))


_BOUND = {"geometry": "a", "inside_outside_lab": "b", "inside_outside_texture": "c", "outside_background_consistency": "d", "internal_content_coverage": "e", "provider_consensus": "f", "model_classical_agreement": "g", "frame_extent": "h"}
_W = " + ".join(f"{w}::DOUBLE * " + (unit_sql(_BOUND[n]) if n in _BOUND else "0.5::DOUBLE") for n, w in e.PRE_SCORE.items())


@register("pre_score", f"""WITH w AS (SELECT *, {_W} AS w FROM {ITEMS}), s AS (SELECT *, least(w, 0.45::DOUBLE * {unit_sql('c')} + 0.55::DOUBLE * w) + CASE WHEN {unit_sql('c')} >= 0.25 AND {unit_sql('f')} >= 0.5 THEN 0.05::DOUBLE * {unit_sql('f')} ELSE 0 END AS s FROM w)
    SELECT l_orderkey, l_linenumber, round({unit_sql("s")}, 10) AS score FROM s""")
def pre_score(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select(*by_item(e.pre_score({n: C(c) for n, c in _BOUND.items()} | {"edge_score": C("c")}), "score", 10))


@register("boundary_risk", f"""WITH r AS (SELECT *, 1.5::DOUBLE * a + 1.75::DOUBLE * b + 1.25::DOUBLE * c + 1.5::DOUBLE * (1 - e) + 0.5::DOUBLE * (1 - f) AS base, abs(g * 0.04::DOUBLE - 0.02::DOUBLE) / 0.04::DOUBLE AS o FROM {ITEMS})
    SELECT l_orderkey, l_linenumber, round(CASE WHEN l_partkey % 2 = 0 THEN base + 0.35::DOUBLE * o + 4 * a + b * 30 / 30.0::DOUBLE + c + (1 - h) ELSE base + 1.5::DOUBLE * o END, 7) AS risk FROM r""")
def boundary_risk(spark: SparkSession, d: str) -> DataFrame:
    profile = {"entropy": C("a"), "second_peak_ratio": C("b"), "maximum_gap_ratio": C("c"), "valid_coverage": C("e"), "support_q50": C("f"), "peak_offset": C("g") * 0.04 - 0.02}
    fit = {"residual_q95": C("a"), "orientation_change_degrees": C("b") * 30, "parent_shift": C("c"), "inlier_ratio": C("h")}
    return items(spark, d).select(*by_item(e.boundary_risk(profile, fit, C("l_partkey") % 2 == 0), "risk"))


@register("upper_adjustment", f"SELECT l_orderkey, l_linenumber, round(0.2::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c + 8 * d + 0.5::DOUBLE * e + 0.1::DOUBLE * (l_partkey % 2), 7) AS adjustment FROM {ITEMS}")
def upper_adjustment(spark: SparkSession, d: str) -> DataFrame:
    option = {"entropy": C("a"), "second_peak_ratio": C("b"), "maximum_gap_ratio": C("c"), "residual_q95": C("d"), "parent_shift": C("e"), "uses_refined_line": C("l_partkey") % 2}
    return items(spark, d).select(*by_item(e.upper_adjustment(option), "adjustment"))


@register("overall_confidence", f"""WITH x AS (SELECT *, coalesce(CASE WHEN l_partkey % 3 = 0 THEN a * 1.2::DOUBLE END, CASE WHEN l_partkey % 5 <> 0 THEN (a + b + c) / 3 END) AS v FROM {ITEMS}) SELECT l_orderkey, l_linenumber, round(CASE WHEN v BETWEEN 0 AND 1 THEN v END, 7) AS confidence FROM x""")
def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    corners = F.when(C("l_partkey") % 5 != 0, F.array("a", "b", "c")).otherwise(F.array().cast("array<double>"))
    return items(spark, d).select(*by_item(e.overall_confidence(F.when(C("l_partkey") % 3 == 0, C("a") * 1.2), corners), "confidence"))


@register("audit_ranks", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 - 3 > 0 THEN l_partkey % 7 - 3 ELSE 1000000 END::BIGINT AS rank, round({unit_sql('coalesce(CASE WHEN l_partkey % 2 = 0 THEN a * 2 END, b)')}, 7) AS score FROM {ITEMS}")
def audit_ranks(spark: SparkSession, d: str) -> DataFrame:
    score = e.audit_score(F.when(C("l_partkey") % 2 == 0, C("a") * 2), F.when(C("l_partkey") % 2 == 0, F.lit(float("nan"))), C("b"))
    return items(spark, d).select("l_orderkey", "l_linenumber", e.audit_rank(C("l_partkey") % 7 - 3).cast("long").alias("rank"), F.round(score, 7).alias("score"))


@register("strong_masks", f"SELECT l_orderkey, l_linenumber, (c >= 0.75 AND e >= 0.8 AND f >= 0.75 AND coalesce(CASE WHEN l_partkey % 2 = 0 THEN g END, 1.0) <= 0.85 AND h * 0.1::DOUBLE <= 0.065) AS strong FROM {ITEMS}")
def strong_masks(spark: SparkSession, d: str) -> DataFrame:
    found = {"foreground_probability": C("c"), "main_component_ratio": C("e"), "polygon_mask_iou": C("f"), "boundary_entropy": F.when(C("l_partkey") % 2 == 0, C("g")), "max_normalized_shift": C("h") * 0.1}
    return items(spark, d).select("l_orderkey", "l_linenumber", e.strong_mask(found).alias("strong"))


@register("angle_dispersion", f"""WITH x AS (SELECT l_orderkey, a * 10 AS v FROM {ITEMS}), p AS (SELECT x.l_orderkey, max(least(abs(x.v - y.v) % pi(), pi() - abs(x.v - y.v) % pi())) AS m FROM x JOIN x y ON x.l_orderkey = y.l_orderkey GROUP BY 1)
    SELECT l_orderkey, round(least(1.0, m / (pi() / 2)), 7) AS dispersion FROM p""")
def angle_dispersion(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).groupBy("l_orderkey").agg(F.collect_list(C("a") * 10).alias("v"))
    return rows.select("l_orderkey", F.round(e.angle_dispersion(C("v")), 7).alias("dispersion"))


@register("boundary_views", f"SELECT l_orderkey, l_linenumber, CASE WHEN a * 0.2::DOUBLE <= 0.08 OR e >= 0.72 OR b * 0.4::DOUBLE >= 0.25 OR c < 0.5 THEN 'identity,horizontal_flip,area_downscale_075,gamma_085,gamma_115,gaussian_blur' ELSE 'identity' END AS views FROM {ITEMS}")
def boundary_views(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("l_orderkey", "l_linenumber", F.array_join(e.views_for(C("a") * 0.2, C("e"), C("b") * 0.4, C("c")), ",").alias("views"))


@register("preconditions", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 'malformed_audit' WHEN l_partkey % 7 = 0 THEN 'missing_risk_audit' WHEN l_partkey % 5 = 0 AND l_suppkey % 2 = 0 THEN 'missing_or_nonfinite_pre_score' END AS reason FROM {ITEMS}")
def preconditions(spark: SparkSession, d: str) -> DataFrame:
    first, second = F.when(C("l_partkey") % 5 == 0, F.lit(float("inf"))).otherwise(C("a")), F.when(C("l_suppkey") % 2 != 0, C("b"))
    return items(spark, d).select("l_orderkey", "l_linenumber", e.precondition(C("l_partkey") % 7 != 0, C("l_partkey") % 11 == 0, first, second).alias("reason"))


_BOX = "a * 300 AS x0, b * 250 AS y0, 999 - c * 300 AS x1, 799 - d * 250 AS y1"


@register("frame_decisions", f"""WITH x AS (SELECT *, {_BOX} FROM {ITEMS}), y AS (SELECT *, {unit_sql('1 - least(x0, y0, 999 - x1, 799 - y1) / 64.0::DOUBLE')} AS near, (x0 > 2 AND y0 > 2 AND x1 < 997 AND y1 < 797) AS seen, ((x1 - x0 + 1) / 1000 >= 0.9 AND (y1 - y0 + 1) / 800 >= 0.9) AS wide, l_partkey % 2 = 0 AS nested FROM x),
    z AS (SELECT *, (seen AND nested AND e >= 0.15 AND f >= 0.35 AND g >= 0.05 AND near >= 0.75) OR (NOT seen AND near >= 0.75 AND wide AND nested AND (g <= 0.08 OR (h <= 0.1 AND a <= 0.15))) AS frame FROM y)
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT seen AND frame THEN 'outside_background_unverifiable,suspected_outer_frame' WHEN NOT seen THEN 'outside_background_unverifiable' WHEN frame THEN 'suspected_outer_frame' ELSE 'none' END AS decisions FROM z""")
def frame_decisions(spark: SparkSession, d: str) -> DataFrame:
    box = {"x0": C("a") * 300, "y0": C("b") * 250, "x1": 999 - C("c") * 300, "y1": 799 - C("d") * 250}
    found = e.frame_decisions(box, F.lit(1000), F.lit(800), C("l_partkey") % 2 == 0, C("e"), C("f"), C("g"), C("h"), C("a"))
    return items(spark, d).select("l_orderkey", "l_linenumber", F.array_join(found, ",").alias("decisions"))


@register("truth_metrics", """WITH n AS (SELECT p_partkey, replace(lower(p_name), ' ', '_') || CASE p_partkey % 6 WHEN 0 THEN '_tp' WHEN 1 THEN '-recall-x' WHEN 2 THEN '_IoU' ELSE '' END AS name FROM part), k AS (SELECT p_partkey, name, lower(regexp_replace(name, '[_-]', '', 'g')) AS k FROM n)
    SELECT p_partkey, name, regexp_matches(k, '^(tp|fp|tn|fn)|(tp|fp|tn|fn)$|truepositive|truenegative|falsepositive|falsenegative|precision|recall|f1|accuracy|groundtruth|truth|intersectionoverunion|iou|error') AS forbidden FROM k""")
def truth_metrics(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(C("p_partkey") % 6 == 0, "_tp").when(C("p_partkey") % 6 == 1, "-recall-x").when(C("p_partkey") % 6 == 2, "_IoU").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace(F.lower("p_name"), " ", "_"), end).alias("name"))
    return rows.select("p_partkey", "name", e.is_truth_metric(C("name")).alias("forbidden"))


@register("strata", "SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS stratum FROM lineitem GROUP BY 1 UNION ALL SELECT -1, 'unlabeled'")
def strata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("v"))
    none = spark.range(1).select(F.lit(-1).cast("long").alias("l_orderkey"), F.array().cast("array<string>").alias("v"))
    return rows.unionByName(none).select("l_orderkey", e.stratum(C("v")).alias("stratum"))


@register("plateau_peaks", """WITH v AS (SELECT user_id, floor(value / 25) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), m AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS b FROM v WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY i) AS r FROM m), s AS (SELECT user_id, r, min(i) AS lo, max(i) AS hi, any_value(v) AS v FROM r GROUP BY 1, 2),
    n AS (SELECT *, coalesce(lag(v) OVER w, -1) AS p, coalesce(lead(v) OVER w, -1) AS q FROM s WINDOW w AS (PARTITION BY user_id ORDER BY r))
    SELECT user_id, count(*) FILTER (v >= p AND v >= q AND (v > p OR v > q)) AS peaks, coalesce(sum((lo + hi) // 2) FILTER (v >= p AND v >= q AND (v > p OR v > q)), 0)::BIGINT AS places FROM n GROUP BY 1""")
def plateau_peaks(spark: SparkSession, d: str) -> DataFrame:
    series = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.floor(C("value") / 25).cast("double").alias("v")))), lambda x: x["v"])
    rows = table(spark, d, "events").groupBy("user_id").agg(series.alias("v")).select("user_id", e.plateau_peaks(C("v")).alias("p"))
    return rows.select("user_id", F.size("p").cast("long").alias("peaks"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x).alias("places"))


@register("edge_seeds", """WITH x AS (SELECT l_suppkey, l_partkey % 40 AS cand, l_orderkey * 10 + l_linenumber AS pos, l_returnflag = 'R' OR l_linenumber = 1 AS ok FROM lineitem), u AS (SELECT l_suppkey, cand, min(pos) AS pos FROM x WHERE ok GROUP BY 1, 2)
    SELECT l_suppkey, cand, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pos, cand)::INTEGER AS place FROM u) WHERE place <= 8""")
def edge_seeds(spark: SparkSession, d: str) -> DataFrame:
    sources = F.array(F.when(C("l_returnflag") == "R", "background:x").otherwise("line"))
    rows = table(spark, d, "lineitem").select("l_suppkey", (C("l_partkey") % 40).alias("cand"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("pos"), sources.alias("sources"), C("l_linenumber").alias("rank"))
    return sel.seeds(rows, ["l_suppkey"], "cand", "pos", e.is_seed(C("sources"), C("rank"), F.lit(None).cast("int"))).select("l_suppkey", "cand", "pos", "place")


@register("ranked_supplements", """WITH x AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_discount AS s, CASE WHEN l_linenumber - 2 > 0 THEN l_linenumber - 2 ELSE 1000000 END AS k, l_returnflag = 'A' AND l_linestatus = 'F' AS x FROM lineitem)
    SELECT l_suppkey, id, x AS supplement, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, x ORDER BY s DESC, k, id)::INTEGER AS place FROM x) WHERE place <= CASE WHEN x THEN 3 ELSE 5 END""")
def ranked_supplements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), C("l_discount").alias("s"), (C("l_linenumber") - 2).alias("k"), "l_returnflag", "l_linestatus")
    extra = e.is_supplement(F.array(F.when(C("l_returnflag") == "A", "background:border_connected").otherwise("line")), C("l_linestatus") == "F")
    return sel.ranked_with_supplements(rows, ["l_suppkey"], C("s"), e.audit_rank(C("k")), "id", extra).select("l_suppkey", "id", "supplement", "place")


@register("cluster_support", "SELECT l_orderkey, count(DISTINCT x) AS seeds, count(DISTINCT l_returnflag) AS sources FROM (SELECT l_orderkey, unnest([l_partkey % 3, l_suppkey % 5]) AS x, l_returnflag FROM lineitem) GROUP BY 1")
def cluster_support(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.array(C("l_partkey") % 3, C("l_suppkey") % 5).alias("s"), F.array("l_returnflag").alias("o"))
    return sel.cluster_support(rows, ["l_orderkey"], "s", "o")


_RECT = "CAST(l_quantity AS DOUBLE) AS x0, l_linenumber * 10.0::DOUBLE AS y0, l_quantity + (l_partkey % 400) + 20.0::DOUBLE AS x1, l_linenumber * 10.0::DOUBLE + l_suppkey % 90 + 20 AS y1"


@register("nested_candidates", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_discount AS s, {_RECT} FROM lineitem), n AS (SELECT a.l_orderkey, a.l_linenumber, max(b.s) AS s FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber
    AND (b.x1 - b.x0) * (b.y1 - b.y0) < 0.9::DOUBLE * (a.x1 - a.x0) * (a.y1 - a.y0) AND b.x0 >= a.x0 AND b.x1 <= a.x1 AND b.y0 >= a.y0 AND b.y1 <= a.y1 GROUP BY 1, 2)
    SELECT r.l_orderkey, r.l_linenumber, n.s IS NOT NULL AS nested, coalesce(n.s, 0.0) AS nested_score FROM r LEFT JOIN n ON n.l_orderkey = r.l_orderkey AND n.l_linenumber = r.l_linenumber""")
def nested_candidates(spark: SparkSession, d: str) -> DataFrame:
    x0, y0 = C("l_quantity").cast("double"), C("l_linenumber") * 10.0
    x1, y1 = x0 + (C("l_partkey") % 400) + 20.0, y0 + C("l_suppkey") % 90 + 20
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", g.quad(x0, y0, x1, y0, x1, y1, x0, y1).alias("q"), C("l_discount").alias("s"))
    return sel.nested(rows, ["l_orderkey"], "l_linenumber", "q", "s")


@register("crop_permits", """SELECT event_id, user_id FROM events r WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'purchase' AND x.value > 50 AND x.user_id = r.user_id AND x.event_id % 10 = r.event_id % 10 AND x.event_id % 7 = r.event_id % 7)""")
def crop_permits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", (C("event_id") % 10).alias("annotation_id"), F.array(C("event_id") % 7).alias("corners"), "event_type", "value")
    done = rows.select("user_id", "annotation_id", "corners", F.when(C("event_type") == "purchase", "confirmation").otherwise("other").alias("event_type"), F.when(C("value") > 50, "FEEDBACK_COMMITTED").alias("transaction_phase"))
    return sel.permitted(rows.where("event_type = 'click'"), done, ["user_id"], "annotation_id", "corners").select("event_id", "user_id")


@register("blinded_view", "SELECT event_id AS image_id, user_id AS origin_group_id, event_type AS stratum FROM events")
def blinded_view(spark: SparkSession, d: str) -> DataFrame:
    return sel.blinded(table(spark, d, "events").select(C("event_id").alias("image_id"), C("user_id").alias("origin_group_id"), C("event_type").alias("stratum"), C("props").alias("detector"), C("value").alias("status")))


@register("run_identity", """WITH h AS (SELECT ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents) SELECT 'validation' AS split, count(*) AS n, sha256('validation:' || count(*) || ':' || coalesce(sum(h::HUGEINT), 0) || ':' || coalesce(bit_xor(h), 0)) AS ids_hash FROM h""")
def run_identity(spark: SparkSession, d: str) -> DataFrame:
    return sel.run_identity(table(spark, d, "documents"), "doc_id", "validation")


_TURNED = {1: ("x", "y"), 2: ("199 - x", "y"), 3: ("199 - x", "99 - y"), 4: ("x", "99 - y"), 5: ("y", "x"), 6: ("99 - y", "x"), 7: ("99 - y", "199 - x"), 8: ("y", "199 - x")}
_CASE = lambda i: " ".join(f"WHEN {k} THEN {v[i]}" for k, v in _TURNED.items())


@register("oriented_points", f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS o, l_quantity::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y FROM lineitem) SELECT l_orderkey, l_linenumber, (CASE o {_CASE(0)} END)::DOUBLE AS x, (CASE o {_CASE(1)} END)::DOUBLE AS y FROM p")
def oriented_points(spark: SparkSession, d: str) -> DataFrame:
    p = g.point(C("l_quantity").cast("double"), (C("l_suppkey") % 100).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.oriented(p, C("l_partkey") % 9, F.lit(200.0), F.lit(100.0)).alias("p")).select("l_orderkey", "l_linenumber", "p.x", "p.y")


_PIX = lambda c, size: ", ".join(f"greatest(0, least({size - 1}, floor(p{c}{i} + 0.5)))::BIGINT AS {c}{i}" for i in range(4))


@register("pixel_corners", f"SELECT vec_id, {_PIX('x', 950)}, {_PIX('y', 720)} FROM {QUAD_SQL}")
def pixel_corners(spark: SparkSession, d: str) -> DataFrame:
    rows = _quads(spark, d).select("vec_id", t.pixels(C("q"), F.lit(950), F.lit(720)).alias("c"))
    return rows.select("vec_id", *[F.get("c", F.lit(i))[a].alias(f"{a}{i}") for a in "xy" for i in range(4)])


@register("full_size_corners", "SELECT vec_id, " + ", ".join(f"greatest(0, least({size - 1}, floor(p{c}{i} * 2.5::DOUBLE + 0.5)))::BIGINT AS {c}{i}" for c, size in (("x", 2500), ("y", 2000)) for i in range(4)) + f" FROM {QUAD_SQL}")
def full_size_corners(spark: SparkSession, d: str) -> DataFrame:
    rows = _quads(spark, d).select("vec_id", t.full_size(C("q"), F.lit(2.5), F.lit(2.5), F.lit(2500), F.lit(2000)).alias("c"))
    return rows.select("vec_id", *[F.get("c", F.lit(i))[a].alias(f"{a}{i}") for a in "xy" for i in range(4)])


@register("display_points", f"""WITH s AS (SELECT vec_id, px0 AS x, py0 AS y FROM {QUAD_SQL}), d AS (SELECT *, round_even(x * 0.4::DOUBLE + 12, 0)::BIGINT AS dx, round_even(y * 0.4::DOUBLE + 7, 0)::BIGINT AS dy FROM s)
    SELECT vec_id, dx, dy, greatest(0, least(999, round_even((dx - 12) / 0.4::DOUBLE, 0)))::BIGINT AS bx, greatest(0, least(799, round_even((dy - 7) / 0.4::DOUBLE, 0)))::BIGINT AS by FROM d""")
def display_points(spark: SparkSession, d: str) -> DataFrame:
    fit = (F.lit(0.4), F.lit(12.0), F.lit(7.0))
    rows = _quads(spark, d).select("vec_id", t.to_display(F.get("q", F.lit(0)), *fit).alias("p"))
    back = t.from_display(C("p"), *fit, F.lit(1000), F.lit(800))
    return rows.select("vec_id", C("p.x").alias("dx"), C("p.y").alias("dy"), back.alias("b")).select("vec_id", "dx", "dy", C("b.x").alias("bx"), C("b.y").alias("by"))


@register("moved_corners", "SELECT l_orderkey, l_linenumber, greatest(0, least(49, l_quantity::BIGINT + l_suppkey % 21 - 10)) AS x, greatest(0, least(5, l_linenumber + l_partkey % 5 - 2))::BIGINT AS y FROM lineitem")
def moved_corners(spark: SparkSession, d: str) -> DataFrame:
    p = F.struct(C("l_quantity").cast("long").alias("x"), C("l_linenumber").cast("long").alias("y"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.moved(p, C("l_suppkey") % 21 - 10, C("l_partkey") % 5 - 2, F.lit(50), F.lit(6)).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "m.x", "m.y")


@register("corner_regions", "WITH s AS (SELECT p_partkey, p_size + 100 AS w, p_size * 2 + 50 AS h FROM part), f AS (SELECT *, floor(w * 0.3::DOUBLE)::BIGINT AS a, floor(h * 0.3::DOUBLE)::BIGINT AS b FROM s) SELECT p_partkey, concat_ws(',', 0, 0, a, b, w - a, 0, w, b, w - a, h - b, w, h, 0, h - b, a, h) AS boxes FROM f")
def corner_regions(spark: SparkSession, d: str) -> DataFrame:
    boxes = F.flatten(t.corner_regions(C("p_size") + 100, C("p_size") * 2 + 50, 0.3))
    return table(spark, d, "part").select("p_partkey", F.array_join(boxes.cast("array<string>"), ",").alias("boxes"))


def _cross(a: str, b: str, c: str, d: str, n: int) -> str:
    """A common table of where the lines ab and cd meet, points named by their columns' prefix and number."""
    x, y = (lambda p: f"{p[0]}x{p[1]}"), (lambda p: f"{p[0]}y{p[1]}")
    u, v = f"({x(b)} - {x(a)}), ({y(b)} - {y(a)})".split(", "), f"({x(d)} - {x(c)}), ({y(d)} - {y(c)})".split(", ")
    k = f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"
    s = f"((({x(c)} - {x(a)}) * {v[1]} - ({y(c)} - {y(a)}) * {v[0]}) / {k})"
    return f"{x(a)} + {s} * {u[0]} AS rx{n}, {y(a)} + {s} * {u[1]} AS ry{n}"


_MET = ", ".join([_cross("p0", "p1", "t3", "t0", 0), _cross("p0", "p1", "t1", "t2", 1), _cross("p2", "p3", "t1", "t2", 2), _cross("p2", "p3", "t3", "t0", 3)])
_SHIFT = lambda n, i: f"sqrt((rx{i} - {n}x{i}) ** 2 + (ry{i} - {n}y{i}) ** 2) / sqrt(1640000.0::DOUBLE)"


@register("recombined_quads", f"WITH r AS (SELECT *, {_MET} FROM {QUAD_SQL}) SELECT vec_id, " + ", ".join(f"round(r{c}{i}, 4) AS {c}{i}" for c in "xy" for i in range(4)) + ", round(greatest(" + ", ".join(f"least({_SHIFT('p', i)}, {_SHIFT('t', i)})" for i in range(4)) + "), 6) AS least_shift, round(greatest(" + ", ".join(f"{_SHIFT(n, i)}" for n in "pt" for i in range(4)) + "), 6) AS most_shift FROM r")
def recombined_quads(spark: SparkSession, d: str) -> DataFrame:
    """Top and bottom of one quad with the sides of another."""
    edges = {"top": C("q"), "bottom": C("q"), "left": C("t"), "right": C("t")}
    rows = _quads(spark, d).select("vec_id", "q", "t", t.recombined(edges).alias("r"))
    rows = rows.withColumn("s", t.parent_shift(C("r"), edges, F.lit(1000.0), F.lit(800.0)))
    return rows.select("vec_id", *[F.round(F.get("r", F.lit(i))[a], 4).alias(f"{a}{i}") for a in "xy" for i in range(4)], F.round("s.least", 6).alias("least_shift"), F.round("s.most", 6).alias("most_shift"))


_SEG = "l_quantity::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y1, (l_partkey % 300)::DOUBLE AS x2, l_linenumber * 20.0::DOUBLE AS y2"


@register("canonical_segments", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS k, {_SEG} FROM lineitem), a AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, CASE WHEN atan2(y2 - y1, x2 - x1) < 0 THEN atan2(y2 - y1, x2 - x1) + pi() WHEN atan2(y2 - y1, x2 - x1) >= pi() THEN atan2(y2 - y1, x2 - x1) - pi() ELSE atan2(y2 - y1, x2 - x1) END AS g FROM s)
    SELECT l_orderkey, l_linenumber, round(g, 6) AS angle, round(len, 6) AS length, round((y1 + y2) * 0.5 * cos(g) - (x1 + x2) * 0.5 * sin(g), 5) + 0.0::DOUBLE AS "offset", round(least(x1 * cos(g) + y1 * sin(g), x2 * cos(g) + y2 * sin(g)), 5) + 0.0::DOUBLE AS low, round(greatest(x1 * cos(g) + y1 * sin(g), x2 * cos(g) + y2 * sin(g)), 5) + 0.0::DOUBLE AS high
    FROM a WHERE len >= greatest(6.0, sqrt(300.0 ** 2 + 200.0 ** 2) * 0.035) AND least(1.0, greatest(0.0, k)) > 0.02""")
def canonical_segments(spark: SparkSession, d: str) -> DataFrame:
    made = t.canonical_segment(C("l_quantity").cast("double"), (C("l_suppkey") % 50).cast("double"), (C("l_partkey") % 300).cast("double"), C("l_linenumber") * 20.0, F.lit(300.0), F.lit(200.0), C("l_discount") * 10)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", made.alias("s")).where("s is not null")
    return rows.select("l_orderkey", "l_linenumber", F.round("s.angle", 6).alias("angle"), F.round("s.length", 6).alias("length"), *[(F.round(f"s.{c}", 5) + 0.0).alias(c) for c in ("offset", "low", "high")])
