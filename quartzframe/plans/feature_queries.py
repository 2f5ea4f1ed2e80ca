"""Registered queries of feature vectors, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.transforms import SIDES
from ..operators import features as ft
from .queries import register, table

C = F.col
WIDTH, HEIGHT = 640, 480
FRAME = (100.0, 80.0, 500.0, 80.0, 500.0, 400.0, 100.0, 400.0)
#: Where a candidate's numbers lie in its vector, counted from 1.
FIRST = {n: 9 + i for i, n in enumerate(ft.NUMBERS)}


def _pool_sql() -> str:
    e = lambda i: f"embedding[{i}]::DOUBLE"
    number = lambda v: f"greatest(-20, least(20, {v}))"
    xy = [f"floor({e(k + 1)} * 40) + {FRAME[k]}::DOUBLE" for k in range(8)]
    numbers = ", ".join(f"{number(e(i) + ' * 8')} AS {n}" for n, i in FIRST.items())
    part = lambda a, b, p: f"abs(({b}x - {a}x) * ({a}y - {p}y) - ({a}x - {p}x) * ({b}y - {a}y)) / sqrt(({b}x - {a}x) * ({b}x - {a}x) + ({b}y - {a}y) * ({b}y - {a}y))"
    gap = f"greatest({part('o.a', 'o.b', 's.a')}, {part('o.a', 'o.b', 's.b')}, {part('s.a', 's.b', 'o.a')}, {part('s.a', 's.b', 'o.b')}) / sqrt({WIDTH * WIDTH + HEIGHT * HEIGHT}::DOUBLE)"
    least = ", ".join(f"min({gap}) FILTER (o.source = '{s}') AS d{k}" for k, s in enumerate(ft.SOURCES))
    agree = lambda limit: "(" + " + ".join(f"coalesce(source <> '{s}' AND d{k} <= {limit}::DOUBLE, false)::INTEGER" for k, s in enumerate(ft.SOURCES)) + ") / 4.0::DOUBLE"
    values = [
        "score", "sign(raw_prior) * ln(1 + abs(raw_prior))", "prior", "area_ratio", "exterior", "valid_sides / 4", "ln(1 + greatest(0, seed_support))", "seed_groups / 4",
        *[f"CASE WHEN k % 7 = 3 AND {i} = 2 THEN 0 ELSE {number(f'sidev[{4 * i} + n]')} END" for i in range(5)], *[f"(source = '{s}')::DOUBLE" for s in ft.SOURCES], "r",
        *[f"coalesce(d{k}, 0.1::DOUBLE) / 0.1::DOUBLE" for k in range(4)], *[agree(a) for a in ft.AGREE],
    ]
    out = ", ".join(f"round({v}, 8) + 0.0::DOUBLE AS {n}" for n, v in zip(ft.POOL_NAMES, values, strict=True))
    return f"""WITH v AS (SELECT concat_ws('/', label::VARCHAR, (vec_id // 60)::VARCHAR) AS image, vec_id AS k, CASE vec_id % 9 % 4 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ft.SOURCES))} END AS source,
        [{", ".join(xy)}] AS c, [x::DOUBLE for x in embedding[20:39]] AS sidev, {numbers} FROM embeddings),
    q AS (SELECT *, percent_rank() OVER (PARTITION BY image, source ORDER BY score DESC, k) AS r FROM v),
    s AS (SELECT * EXCLUDE (c), c[2 * n - 1] AS ax, c[2 * n] AS ay, c[2 * n % 8 + 1] AS bx, c[2 * n % 8 + 2] AS by FROM q, range(1, 5) AS t(n)),
    d AS (SELECT s.k, s.n, {least} FROM s JOIN s AS o ON s.image = o.image AND s.n = o.n AND s.k <> o.k GROUP BY ALL)
    SELECT image, k AS candidate, [{", ".join(f"'{x}'" for x in SIDES)}][n] AS edge, {out} FROM s LEFT JOIN d USING (k, n)"""


@register("pool_vectors", _pool_sql())
def pool_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as candidates of images: each edge's features against the image's other candidates."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    k = C("vec_id")
    corners = g.quad(*[F.floor(e(i + 1) * 40) + FRAME[i] for i in range(8)])
    side = lambda i: F.transform(F.slice("embedding", 20 + 4 * i, 4), lambda x: x.cast("double"))
    sides = [side(i) if i != 2 else F.when(k % 7 != 3, side(i)) for i in range(5)]
    rows = table(spark, d, "embeddings").select(
        F.concat_ws("/", C("label").cast("string"), F.floor(k / 60).cast("string")).alias("image"), k.alias("candidate"), F.get(F.array(*map(F.lit, ft.SOURCES)), (k % 9 % 4).cast("int")).alias("source"),
        corners.alias("corners"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), *[(e(i) * 8).alias(n) for n, i in FIRST.items()], *[s.alias(n) for s, n in zip(sides, ft.PER_SIDE, strict=True)],
    )
    made = ft.pool_vectors(rows, ["image"])
    return made.select("image", "candidate", "edge", *[(F.round(F.get("features", F.lit(i)), 8) + 0.0).alias(n) for i, n in enumerate(ft.POOL_NAMES)])


def _relative_sql() -> str:
    four = lambda i: f"[embedding[{i} + j]::DOUBLE for j in range(0, 4)]"
    at = {"edge_risks": 1, "upper_corner_risks": 5, "edge_margins": 9, "cross_source_support": 13}
    fields = {"entropy": 17, "second_peak_ratio": 21, "maximum_gap_ratio": 25, "valid_coverage": 29, "support_q10": 33, "peak_offset": 37, "residual_q95": 41, "inlier_ratio": 45, "orientation_change_degrees": 49, "parent_shift": 53}
    views = {"maximum_endpoint_deviation": 57, "view_agreement_ratio": 61, "view_failure_ratio": 3}
    a = {n: four(i) for n, i in (at | fields).items()} | {"accepted": "[(embedding[41 + j] > 0)::INTEGER::DOUBLE for j in range(0, 4)]"}
    a |= {f"adaptive_{n}": four(i) for n, i in views.items()} | {f"all_{n}": four(i - 2) for n, i in views.items()}
    mean = lambda n: f"({' + '.join(f'{a[n]}[{j}]' for j in (1, 2, 3, 4))}) / 4"
    low, high = (lambda n: f"list_min({a[n]})"), (lambda n: f"list_max({a[n]})")
    moved = [f"sqrt(power(embedding[{i}]::DOUBLE * 10, 2) + power(embedding[{i + 1}]::DOUBLE * 10, 2))" for i in (1, 3, 5, 7)]
    size = f"sqrt({WIDTH * WIDTH + HEIGHT * HEIGHT}::DOUBLE)"
    out = {
        "proposal_edge_risk_min": low("edge_risks"), "proposal_edge_risk_mean": mean("edge_risks"), "proposal_edge_risk_max": high("edge_risks"), "proposal_edge_risk_spread": f"{high('edge_risks')} - {low('edge_risks')}",
        "proposal_upper_risk_max": high("upper_corner_risks"), "proposal_edge_margin_min": low("edge_margins"), "proposal_edge_margin_mean": mean("edge_margins"), "proposal_edge_margin_max": high("edge_margins"),
        "proposal_cross_source_support_min": low("cross_source_support"), "proposal_cross_source_support_mean": mean("cross_source_support"), "profile_entropy_mean": mean("entropy"), "profile_entropy_max": high("entropy"),
        "profile_second_peak_mean": mean("second_peak_ratio"), "profile_second_peak_max": high("second_peak_ratio"), "profile_maximum_gap_max": high("maximum_gap_ratio"), "profile_valid_coverage_min": low("valid_coverage"),
        "profile_support_q10_min": low("support_q10"), "profile_absolute_peak_offset_max": f"list_max([abs(x) for x in {a['peak_offset']}])", "refinement_acceptance_ratio": mean("accepted"), "refined_edge_ratio": "vec_id % 5 / 4.0::DOUBLE",
        "refinement_residual_q95_max": high("residual_q95"), "refinement_inlier_ratio_min": low("inlier_ratio"), "refinement_orientation_change_max": f"{high('orientation_change_degrees')} / 30", "refinement_parent_shift_max": high("parent_shift"),
        "geometry_legal_min_parent_anchor": "coalesce(label % 3 = 0, false)::INTEGER", "geometry_legal_both_parent_anchor": "(vec_id % 4 = 1)::INTEGER", "geometry_max_min_parent_displacement": "CASE WHEN vec_id % 3 = 0 THEN 1 ELSE embedding[60]::DOUBLE END",
        "current_proposal_corner_distance_mean": f"({' + '.join(moved)}) / 4 / {size}", "current_proposal_corner_distance_max": f"greatest({', '.join(moved)}) / {size}",
    } | {f"{k}_consistency_{n}": v for k, p in (("adaptive", "adaptive_"), ("all_view", "all_")) for n, v in (
        ("endpoint_max", high(p + "maximum_endpoint_deviation")), ("agreement_min", low(p + "view_agreement_ratio")), ("agreement_mean", mean(p + "view_agreement_ratio")),
        ("failure_max", high(p + "view_failure_ratio")), ("failure_mean", mean(p + "view_failure_ratio")))} | {
        "status_automatic": "(vec_id % 5 IN (0, 1))::INTEGER", "status_manual_review": "(vec_id % 5 IN (2, 3))::INTEGER", "reason_other": "(vec_id % 6 > 3)::INTEGER",
    } | {f"reason_{r}": f"(vec_id % 6 = {i})::INTEGER" for i, r in enumerate(ft.REASONS)}
    return "SELECT vec_id, " + ", ".join(f"round(({v})::DOUBLE, 9) + 0.0::DOUBLE AS {n}" for n, v in out.items()) + " FROM embeddings"


@register("relative_features", _relative_sql())
def relative_features(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as proposals of four edges against the corners of now."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    four = lambda i: F.array(*[e(i + j) for j in range(4)])
    structs = lambda **at: F.array(*[F.struct(*[e(i + j).alias(n) for n, i in at.items()]) for j in range(4)])
    refined = F.array(*[F.struct((e(41 + j) > 0).alias("accepted"), e(41 + j).alias("residual_q95"), e(45 + j).alias("inlier_ratio"), e(49 + j).alias("orientation_change_degrees"), e(53 + j).alias("parent_shift")) for j in range(4)])
    k = C("vec_id")
    named = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), (k % n).cast("int"))
    rows = table(spark, d, "embeddings").select(
        k, four(1).alias("edge_risks"), four(5).alias("upper_corner_risks"), four(9).alias("edge_margins"), four(13).alias("cross_source_support"),
        structs(entropy=17, second_peak_ratio=21, maximum_gap_ratio=25, valid_coverage=29, support_q10=33, peak_offset=37).alias("profiles"), refined.alias("refinements"),
        structs(maximum_endpoint_deviation=57, view_agreement_ratio=61, view_failure_ratio=3).alias("adaptive"), structs(maximum_endpoint_deviation=55, view_agreement_ratio=59, view_failure_ratio=1).alias("all_views"),
        g.quad(*map(F.lit, FRAME)).alias("current"), g.quad(*[e(i + 1) * 10 + FRAME[i] for i in range(8)]).alias("proposed"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
        (k % 5).alias("refined_edges"), (C("label") % 3 == 0).alias("legal_min_parent"), (k % 4 == 1).alias("legal_both_parent"), F.when(k % 3 != 0, e(60)).alias("parent_displacement"),
        named(5, *ft.AUTOMATIC, *ft.MANUAL, "skipped").alias("status"), named(6, *ft.REASONS, "unheard_of").alias("reason"),
    )
    made = ft.relative_features(rows, ["vec_id"])
    return made.select("vec_id", *[(F.round(n, 9) + 0.0).alias(n) for n in made.columns if n != "vec_id"])
