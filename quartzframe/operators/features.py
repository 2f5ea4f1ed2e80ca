"""Ordered feature vectors of a candidate's edges against the pool that it is in, without anything derived from truth."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.stats import clamped_number
from ..functions.transforms import SIDES
from .ranking import rank_fraction

C = F.col
#: Sources, names and their order, limits.
SOURCES = ("edge", "v7_current", "v7_seed", "mask")
NUMBERS = ("score", "raw_prior", "prior", "area_ratio", "exterior", "valid_sides", "seed_support", "seed_groups")
PER_SIDE = ("side_scores", "side_bed_scores", "side_connected_scores", "side_stability_scores", "side_coverages")
FAR, AGREE = 0.1, (0.005, 0.01, 0.02)
POOL_NAMES = (
    "score", "raw_prior_log", "prior_score_normalized", "area_ratio", "exterior_score", "valid_side_ratio", "seed_support_log", "seed_source_group_ratio",
    "side_score", "side_bed_score", "side_connected_score", "side_stability_score", "side_coverage", *(f"source_{s}" for s in SOURCES),
    "source_rank_fraction", *(f"distance_to_{s}" for s in SOURCES), "agreement_source_fraction_005", "agreement_source_fraction_010", "agreement_source_fraction_020",
)
EDGE_NAMES = tuple(f"edge_{s}" for s in SIDES)
PROFILE = ("peak_offset", "peak_width", "entropy", "second_peak_ratio", "support_q10", "support_q50", "support_q90", "maximum_gap_ratio", "valid_coverage")
REFINEMENT = ("residual_q50", "residual_q90", "residual_q95", "inlier_ratio", "orientation_change", "parent_shift", "accepted")
CONSISTENCY = ("peak_offset_dispersion", "line_angle_dispersion", "maximum_endpoint_deviation", "view_agreement_ratio", "view_failure_ratio")
NAMES = (*POOL_NAMES, *EDGE_NAMES, *(f"profile_{n}" for n in PROFILE), *(f"refinement_{n}" for n in REFINEMENT), "candidate_uses_refined_line", *(f"consistency_{n}" for n in CONSISTENCY))
MASK = ("peak_offset", "zero_crossing_width", "entropy", "inside_foreground", "outside_background", "transition_strength", "valid_coverage", "lab_disagreement")
MODES = {"metadata": len(POOL_NAMES) + 4, "profile": len(POOL_NAMES) + 4 + len(PROFILE), "full": len(NAMES)}
FORBIDDEN = r"(?i)^(truth|strict|catastrophic|edge_strict_candidate)$|(_strict|_catastrophic|_truth)$|normalized_corner_error|strict_candidate|first_strict_rank"
BAND = 0.04
BLOCK = 512


def leaks(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the fields of a schema, nested ones too, whose names tell of truth."""
    if isinstance(schema, T.ArrayType):
        return leaks(schema.elementType, prefix + "[]")
    if isinstance(schema, T.MapType):
        return leaks(schema.valueType, prefix + "{}")
    if not isinstance(schema, T.StructType):
        return []
    found = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        found += ([path] if re.search(FORBIDDEN, field.name) else []) + leaks(field.dataType, path)
    return found


def without_leaks(rows: DataFrame, *maps: str) -> DataFrame:
    """The rows; a field named after truth raises when the plan is made, a key of ``maps`` when its row is read."""
    if found := leaks(rows.schema):
        raise ValueError(f"truth-derived field in runtime evidence: {found[0]}")
    for m in maps:
        bad = F.get(F.filter(F.map_keys(m), lambda k: k.rlike(FORBIDDEN)), F.lit(0))
        rows = rows.withColumn(m, F.when(bad.isNull(), C(m)).otherwise(F.raise_error(F.concat(F.lit("truth-derived field in runtime evidence: "), bad))))
    return rows


def _nearest(sides: DataFrame, block: int) -> DataFrame:
    """For each different line of a pool's side: the least distance to another line of each source, and how many candidates of each have the line itself.

    A line is met with those of its pool and side only, block by block, so that a large pool is spread over the squares of its blocks; equal
    lines are one beforehand. Pairs are reduced to four minima in the task that makes them.
    """
    lines = sides.groupBy("_pool", "_side", "_line").agg(*[F.count(F.when(C("source") == s, 1)).alias(f"_n{k}") for k, s in enumerate(SOURCES)])
    blocks = lines.groupBy("_pool", "_side").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    placed = lines.join(blocks, ["_pool", "_side"]).withColumn("_in", F.pmod(F.xxhash64("_line"), C("_blocks")))
    every = F.explode(F.sequence(F.lit(0), C("_blocks") - 1))
    left = placed.select("_pool", "_side", "_line", C("_in").alias("_i"), every.alias("_j"))
    right = placed.select("_pool", "_side", C("_line").alias("_other"), C("_in").alias("_j"), *[f"_n{k}" for k in range(4)], every.alias("_i"))
    ends = lambda line: (g.point(line["ax"], line["ay"]), g.point(line["bx"], line["by"]))
    (a, b), (c, d) = ends(C("_line")), ends(C("_other"))
    gap = F.greatest(g.point_line_distance(a, c, d), g.point_line_distance(b, c, d), g.point_line_distance(c, a, b), g.point_line_distance(d, a, b))
    gap = F.when((g.distance(a, b) > 0) & (g.distance(c, d) > 0), gap)
    same = C("_line") == C("_other")
    pairs = left.join(right, ["_pool", "_side", "_i", "_j"]).withColumn("_gap", gap).withColumn("_same", same)
    least = [F.min(F.when(~C("_same") & (C(f"_n{k}") > 0), C("_gap"))).alias(f"_d{k}") for k in range(4)]
    own = [F.max(F.when(C("_same"), C(f"_n{k}"))).alias(f"_own{k}") for k in range(4)]
    return pairs.groupBy("_pool", "_side", "_line").agg(*least, *own)


def pool_vectors(rows: DataFrame, by: list[str], candidate: str = "candidate", block: int = BLOCK) -> DataFrame:
    """Rows (by, source, candidate, edge, features): the 25 values of ``POOL_NAMES`` for each candidate and edge.

    Columns: ``by``, ``candidate``, source (one of SOURCES, else an error), corners (a quad), width, height, NUMBERS and PER_SIDE (arrays of four).
    A missing or infinite number is 0, an array without four values is zeros. Distances and agreement leave the candidate itself out; a source
    without another candidate is at ``FAR``. Rows of one source and candidate are one, the least in the order of these columns.
    A null pool is a pool. Equal edges are at distance 0; an edge without length is at no distance from others.
    """
    without_leaks(rows)
    used = ["corners", "width", "height", *NUMBERS, *PER_SIDE]
    pools = rows.select(F.struct(*by).alias("_pool"), "source", C(candidate).alias("_candidate"), F.struct(*used).alias("_row"))
    one = pools.groupBy("_pool", "source", "_candidate").agg(F.min("_row").alias("_row"))
    known = F.when(C("source").isin(*SOURCES), C("source")).otherwise(F.raise_error(F.concat(F.lit("unsupported source: "), F.coalesce("source", F.lit("null")))))
    one = one.select("_pool", known.alias("source"), "_candidate", "_row.*")
    one = rank_fraction(one, ["_pool", "source"], [clamped_number(C("score")).desc(), C("_candidate")])
    at = lambda i, v: F.get("corners", F.lit(i % 4))[v]
    line = lambda i: F.struct(at(i, "x").alias("ax"), at(i, "y").alias("ay"), at(i + 1, "x").alias("bx"), at(i + 1, "y").alias("by"))
    sides = one.select("*", F.posexplode(F.array(*[line(i) for i in range(4)])).alias("_side", "_line"))
    met = sides.join(_nearest(sides, block), ["_pool", "_side", "_line"], "left")

    number = lambda n: clamped_number(C(n).cast("double"))
    side = lambda n: F.when(F.size(n) == 4, clamped_number(F.get(n, C("_side")).cast("double"))).otherwise(F.lit(0.0))
    size = g.diagonal(C("width"), C("height"))
    mine = [(C("source") == s).cast("double") for s in SOURCES]
    near = [F.when(C(f"_own{k}") > mine[k], F.lit(0.0)).otherwise(C(f"_d{k}") / size) for k in range(4)]
    met = met.select("*", *[n.alias(f"_near{k}") for k, n in enumerate(near)])
    agreeing = [sum((F.coalesce((C("source") != s) & (C(f"_near{k}") <= limit), F.lit(False)).cast("double") for k, s in enumerate(SOURCES)), F.lit(0.0)) / len(SOURCES) for limit in AGREE]
    values = [
        number("score"), F.signum(number("raw_prior")) * F.log1p(F.abs(number("raw_prior"))), number("prior"), number("area_ratio"), number("exterior"), number("valid_sides") / 4,
        F.log1p(F.greatest(F.lit(0.0), number("seed_support"))), number("seed_groups") / 4, *[side(n) for n in PER_SIDE], *mine, C("rank_fraction"),
        *[F.coalesce(C(f"_near{k}"), F.lit(FAR)) / FAR for k in range(4)], *agreeing,
    ]
    edge = F.get(F.array(*map(F.lit, SIDES)), C("_side"))
    return met.select("_pool.*", "source", C("_candidate").alias(candidate), edge.alias("edge"), F.array(*values).alias("features"))


def _finite(value: Column, name: str) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(ok, value).otherwise(F.raise_error(F.lit(f"runtime feature must be finite: {name}")))


def evidence_vector(features: Column, edge: Column, profile: Column, refinement: Column, refined: Column, consistency: Column | None = None) -> Column:
    """The 51 values of ``NAMES``: pool features, edge, profile, refinement (its change of orientation in degrees), use of the refined line, consistency.

    Missing consistency is 0; any other missing or infinite value raises.
    """
    values = [F.get(features, F.lit(i)) for i in range(len(POOL_NAMES))] + [(edge == s).cast("double") for s in SIDES] + [profile[n].cast("double") for n in PROFILE]
    values += [refinement["orientation_change_degrees"] / 30.0 if n == "orientation_change" else refinement[n].cast("double") for n in REFINEMENT]
    values += [refined.cast("double")] + [F.lit(0.0) if consistency is None else F.coalesce(consistency[n].cast("double"), F.lit(0.0)) for n in CONSISTENCY]
    return F.array(*[_finite(v, n) for n, v in zip(NAMES, values, strict=True)])


def masked(features: Column, mode: str) -> Column:
    """A vector of ``NAMES`` with zeros for what the mode doesn't use; a vector of another length or with missing values raises."""
    if mode not in MODES:
        raise ValueError(f"unsupported feature mode: {mode}")
    bad = F.coalesce(F.size(features) != len(NAMES), F.lit(True)) | F.exists(features, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = F.transform(features, lambda v, i: F.when(i < MODES[mode], v).otherwise(F.lit(0.0)))
    return F.when(~bad, kept).otherwise(F.raise_error(F.lit("cached feature vector is invalid")))


def mask_vector(evidence: Column, peak: str = "signed") -> Column:
    """The values of ``MASK`` with the peak's offset signed, absolute or both; values out of their ranges raise."""
    first, *rest = [_finite(evidence[n].cast("double"), f"mask_{n}") for n in MASK]
    offsets = {"signed": [first], "absolute": [F.abs(first)], "signed_absolute": [first, F.abs(first)]}
    if peak not in offsets:
        raise ValueError(f"unsupported peak mode: {peak}")
    ok = first.between(-BAND, BAND)
    for v in rest:
        ok = ok & v.between(0.0, 1.0)
    return F.when(ok, F.array(*offsets[peak], *rest)).otherwise(F.raise_error(F.lit("mask evidence is out of its ranges")))


def option_vectors(options: DataFrame, key: list[str], mode: str, masks: DataFrame | None = None, peak: str = "signed") -> DataFrame:
    """Options with ``vector``: their ``features`` masked and, with ``masks`` (key, mask), the mask's values behind; an option without a mask raises."""
    base = masked(C("features"), mode)
    if masks is None:
        return options.withColumn("vector", base)
    joined = options.join(masks.select(*key, "mask"), key, "left")
    found = F.when(C("mask").isNotNull(), mask_vector(C("mask"), peak)).otherwise(F.raise_error(F.lit("mask witness option is missing")))
    return joined.withColumn("vector", F.concat(base, found)).select(*options.columns, "vector")


#: Names, where each value is found and how four of them become one.
AUTOMATIC, MANUAL = ("automatic", "v7_fallback"), ("manual_review", "rescan_required")
REASONS = ("edge_base", "v7_edge_unresolved_conflict", "v7_edge_agreement_rescue", "strong_three_way_conflict")
OVER_EDGES = {
    "proposal_edge_risk": ("edge_risks", None, "min mean max spread"),
    "proposal_upper_risk": ("upper_corner_risks", None, "max"),
    "proposal_edge_margin": ("edge_margins", None, "min mean max"),
    "proposal_cross_source_support": ("cross_source_support", None, "min mean"),
    "profile_entropy": ("profiles", "entropy", "mean max"),
    "profile_second_peak": ("profiles", "second_peak_ratio", "mean max"),
    "profile_maximum_gap": ("profiles", "maximum_gap_ratio", "max"),
    "profile_valid_coverage": ("profiles", "valid_coverage", "min"),
    "profile_support_q10": ("profiles", "support_q10", "min"),
    "profile_absolute_peak_offset": ("profiles", "peak_offset", "absmax"),
    "refinement_acceptance_ratio": ("refinements", "accepted", "mean"),
    "refinement_residual_q95": ("refinements", "residual_q95", "max"),
    "refinement_inlier_ratio": ("refinements", "inlier_ratio", "min"),
    "refinement_orientation_change": ("refinements", "orientation_change_degrees", "max"),
    "refinement_parent_shift": ("refinements", "parent_shift", "max"),
} | {
    f"{kind}_consistency_{short}": (views, field, how)
    for kind, views in (("adaptive", "adaptive"), ("all_view", "all_views"))
    for short, field, how in (("endpoint", "maximum_endpoint_deviation", "max"), ("agreement", "view_agreement_ratio", "min mean"), ("failure", "view_failure_ratio", "max mean"))
}


def _folded(values: Column, how: str) -> Column:
    least, most = F.array_min(values), F.array_max(values)
    return {"min": least, "max": most, "mean": g.total(values) / 4, "spread": most - least, "absmax": F.array_max(F.transform(values, F.abs))}[how]


def relative_features(rows: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Rows (keep, the 46 values): a proposal against the current corners, by what is known at run time.

    Columns: the arrays of four (in the order of SIDES) that OVER_EDGES names, current and proposed (quads), width, height, refined_edges,
    legal_min_parent, legal_both_parent, parent_displacement (null: 1), status, reason. An array of another length and any missing value raise.
    """
    without_leaks(rows)
    out = {}
    for name, (column, field, hows) in OVER_EDGES.items():
        values = (C(column)[field] if field else C(column)).cast("array<double>")
        # a null among the four would be passed over by the minimum
        values = F.when((F.size(column) == 4) & ~F.exists(values, lambda v: v.isNull()), values)
        scale = 30.0 if name == "refinement_orientation_change" else 1.0
        for how in hows.split():
            out[name if name.endswith("_ratio") and field == "accepted" else f"{name}_{how.removeprefix('abs')}"] = _folded(values, how) / scale
    gaps = g.corner_distances(C("proposed"), C("current"))
    size = g.diagonal(C("width"), C("height"))
    out |= {
        "refined_edge_ratio": C("refined_edges") / 4.0,
        "geometry_legal_min_parent_anchor": F.coalesce("legal_min_parent", F.lit(False)).cast("double"),
        "geometry_legal_both_parent_anchor": F.coalesce("legal_both_parent", F.lit(False)).cast("double"),
        "geometry_max_min_parent_displacement": F.coalesce("parent_displacement", F.lit(1.0)),
        "current_proposal_corner_distance_mean": g.total(gaps) / 4 / size,
        "current_proposal_corner_distance_max": F.array_max(gaps) / size,
        "status_automatic": F.coalesce(C("status").isin(*AUTOMATIC), F.lit(False)).cast("double"),
        "status_manual_review": F.coalesce(C("status").isin(*MANUAL), F.lit(False)).cast("double"),
        "reason_other": (~F.coalesce(C("reason").isin(*REASONS), F.lit(False))).cast("double"),
    } | {f"reason_{r}": F.coalesce(C("reason") == r, F.lit(False)).cast("double") for r in REASONS}
    return rows.select(*keep, *[_finite(v, n).alias(n) for n, v in out.items()])
