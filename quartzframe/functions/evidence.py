"""Scores, risks and predicates over a candidate's evidence, as column expressions."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g
from .stats import finite

#: Weights of a candidate's cheap score.
PRE_SCORE = {
    "geometry": 0.24, "inside_outside_lab": 0.09, "inside_outside_texture": 0.07, "outside_background_consistency": 0.08, "internal_content_coverage": 0.07,
    "provider_consensus": 0.04, "model_classical_agreement": 0.02, "candidate_margin": 0.04, "nesting": 0.05, "frame_extent": 0.30,
}
#: Defaults of parts that are unknown, weights of a boundary's risk, limits of a strong mask and of ambiguity, and the views.
UNKNOWN_HALF = ("candidate_margin", "nesting", "frame_extent")
AMBIGUITY = {"entropy": 1.50, "second_peak_ratio": 1.75, "maximum_gap_ratio": 1.25}
UPPER = {"entropy": 0.20, "second_peak_ratio": 0.30, "maximum_gap_ratio": 0.20, "residual_q95": 8.0, "parent_shift": 0.50, "uses_refined_line": 0.10}
STRONG_MASK = {"foreground_probability": 0.75, "main_component_ratio": 0.80, "polygon_mask_iou": 0.75, "boundary_entropy": 0.85, "max_normalized_shift": 0.065}
VIEWS = ("identity", "horizontal_flip", "area_downscale_075", "gamma_085", "gamma_115", "gaussian_blur")
LAST_RANK = 1_000_000
#: Names that give away a metric derived from labels.
TRUTH_WORDS = ("truepositive", "truenegative", "falsepositive", "falsenegative", "precision", "recall", "f1", "accuracy", "groundtruth", "truth", "intersectionoverunion", "iou", "error")


def unit(value: Column, default: float = 0.0) -> Column:
    """The value between 0 and 1; ``default`` where it is null or not finite."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(finite(value), F.lit(default))))


def edge_support(edges: Column) -> Column:
    """Mean over edges (support, direction, gradient) of half the support and a quarter of each of the others; 0 without edges."""
    each = F.transform(edges, lambda e: unit(e["support"]) * 0.5 + unit(e["direction"]) * 0.25 + unit(e["gradient"]) * 0.25)
    return F.when(F.coalesce(F.size(edges), F.lit(0)) > 0, g.total(each) / F.size(edges)).otherwise(0.0)


def pre_score(scores: dict[str, Column]) -> Column:
    """Weighted parts, held down by a weak edge, raised a little where providers agree on an edge that can be used."""
    part = lambda n: unit(scores.get(n, F.lit(None).cast("double")), 0.5 if n in UNKNOWN_HALF else 0.0)
    weighted = functools.reduce(operator.add, [part(n) * w for n, w in PRE_SCORE.items()])
    edge, agreed = part("edge_score"), part("provider_consensus")
    gated = F.least(weighted, edge * 0.45 + weighted * 0.55)
    return unit(gated + F.when((edge >= 0.25) & (agreed >= 0.5), agreed * 0.05).otherwise(0.0))


def boundary_risk(profile: dict[str, Column], refinement: dict[str, Column], refined: Column, band: float = 0.04) -> Column:
    """Ambiguity of a boundary's profile, with its offset and, for a refined line, how badly it fits."""
    base = functools.reduce(operator.add, [profile[n] * w for n, w in AMBIGUITY.items()]) + (1 - profile["valid_coverage"]) * 1.50 + (1 - profile["support_q50"]) * 0.50
    offset = F.abs(profile["peak_offset"]) / max(1e-12, band)
    fit = refinement["residual_q95"] * 4.0 + refinement["orientation_change_degrees"] / 30.0 + refinement["parent_shift"] + (1 - refinement["inlier_ratio"])
    return F.when(refined, base + offset * 0.35 + fit).otherwise(base + offset * 1.50)


def upper_adjustment(option: dict[str, Column]) -> Column:
    """What uncertainty adds to the upper estimate of a boundary option."""
    return functools.reduce(operator.add, [option[n].cast("double") * w for n, w in UPPER.items()])


def overall_confidence(overall: Column, corners: Column) -> Column:
    """A row's confidence, else the mean of its corners'; null unless it lies between 0 and 1."""
    mean = F.when(F.size(corners) > 0, g.total(F.transform(corners, lambda x: x.cast("double"))) / F.size(corners))
    return F.when(finite(F.coalesce(overall, mean)).between(0.0, 1.0), F.coalesce(overall, mean))


def audit_rank(rank: Column) -> Column:
    """A positive rank, else one behind all."""
    return F.coalesce(F.when(rank > 0, rank), F.lit(LAST_RANK))


def audit_score(*scores: Column) -> Column:
    """The first finite of full, plain and cheap score, between 0 and 1."""
    return unit(F.coalesce(*[finite(s) for s in scores]))


def is_seed(sources: Column, selected_rank: Column, pre_rank: Column) -> Column:
    """Whether a candidate comes from a background provider or is first of its stage."""
    first = F.coalesce(selected_rank == 1, F.lit(False)) | F.coalesce(pre_rank == 1, F.lit(False))
    return F.coalesce(F.exists(sources, lambda s: s.startswith("background:")), F.lit(False)) | first


def is_supplement(sources: Column, supplemental_only: Column) -> Column:
    """Whether a candidate is there only as the scanner's supplement."""
    only = (F.size(F.array_distinct(sources)) == 1) & F.array_contains(sources, "background:border_connected")
    return F.coalesce(only & supplemental_only, F.lit(False))


def strong_mask(evidence: dict[str, Column]) -> Column:
    """Five limits on a mask's evidence; unknown entropy is the worst, an unknown shift none."""
    known = {n: F.coalesce(evidence.get(n, F.lit(None)).cast("double"), F.lit(1.0 if n == "boundary_entropy" else 0.0)) for n in STRONG_MASK}
    low = [known[n] >= STRONG_MASK[n] for n in ("foreground_probability", "main_component_ratio", "polygon_mask_iou")]
    high = [(known[n] <= STRONG_MASK[n]) & ~F.isnan(known[n]) for n in ("boundary_entropy", "max_normalized_shift")]
    return functools.reduce(operator.and_, [*low, *high])


def angle_dispersion(angles: Column) -> Column:
    """Largest difference of undirected angles as a share of a right angle; 0 for fewer than two."""
    apart = lambda a, b: F.least(F.pmod(F.abs(a - b), F.lit(math.pi)), math.pi - F.pmod(F.abs(a - b), F.lit(math.pi)))
    most = F.array_max(F.transform(angles, lambda a: F.array_max(F.transform(angles, lambda b: apart(a, b)))))
    return F.when(F.size(angles) < 2, 0.0).otherwise(F.least(F.lit(1.0), most / (math.pi / 2)))


def views_for(margin: Column, entropy: Column, second_peak: Column, coverage: Column) -> Column:
    """All views for an ambiguous boundary, else the plain one."""
    unclear = (margin <= 0.08) | (entropy >= 0.72) | (second_peak >= 0.25) | (coverage < 0.5)
    return F.when(unclear, F.array(*map(F.lit, VIEWS))).otherwise(F.array(F.lit(VIEWS[0])))


def precondition(has_audit: Column, malformed: Column, *scores: Column) -> Column:
    """Why a candidate may not be ranked: its audit is malformed or missing, or no cheap score is finite; else null."""
    return F.when(malformed, "malformed_audit").when(~has_audit, "missing_risk_audit").when(F.coalesce(*[finite(s) for s in scores]).isNull(), "missing_or_nonfinite_pre_score")


def frame_decisions(box: dict[str, Column], width: Column, height: Column, nested: Column, nested_score: Column, background: Column, content: Column, edge: Column, direction: Column) -> Column:
    """Risk decisions on a candidate's bounding box (x0, y0, x1, y1): whether its outside can be seen, and whether it may be a frame."""
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    near = unit(1.0 - F.least(x0, y0, width - 1 - x1, height - 1 - y1) / F.greatest(F.least(width, height) * 0.08, F.lit(1.0)))
    seen = (x0 > 2) & (y0 > 2) & (x1 < width - 3) & (y1 < height - 3)
    wide = (unit((x1 - x0 + 1) / F.greatest(width, F.lit(1.0))) >= 0.90) & (unit((y1 - y0 + 1) / F.greatest(height, F.lit(1.0))) >= 0.90)
    inner = nested & (nested_score >= 0.15) & (unit(background, 0.5) >= 0.35) & (unit(content, 0.5) >= 0.05)
    cue = (unit(content, 0.5) <= 0.08) | (unit(edge, 0.5) <= 0.10) & (unit(direction, 0.5) <= 0.15)
    frame = seen & inner & (near >= 0.75) | ~seen & (near >= 0.75) & wide & nested & cue
    found = F.array_compact(F.array(F.when(~seen, "outside_background_unverifiable"), F.when(frame, "suspected_outer_frame")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def is_truth_metric(name: Column) -> Column:
    """Whether a metric's name speaks of labels: a confusion-matrix abbreviation at either end, or one of TRUTH_WORDS."""
    plain = F.lower(F.regexp_replace(name, "[_-]", ""))
    return plain.rlike("^(tp|fp|tn|fn)|(tp|fp|tn|fn)$|" + "|".join(TRUTH_WORDS))


def stratum(labels: Column) -> Column:
    """Sorted labels in one text, or ``unlabeled``."""
    text = F.array_join(F.array_sort(labels), "|")
    return F.when(F.coalesce(text, F.lit("")) == "", "unlabeled").otherwise(text)


def plateau_peaks(values: Column) -> Column:
    """Middles of the runs of equal values that are higher than one neighbour run and not lower than the other; outside lies -1.

    One fold over the values keeps the run so far, the value before it and the peaks found.
    """
    double = lambda x: x.cast("double")
    same = lambda a, b: F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-10, F.lit(1e-15))
    start = F.struct(F.lit(-1.0).alias("before"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("begin"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def peak(s: Column, after: Column) -> Column:
        high = (s["first"] >= s["before"]) & (s["first"] >= after) & ((s["first"] > s["before"]) | (s["first"] > after))
        return F.when(high, F.concat(s["found"], F.array(F.floor((s["begin"] + s["at"] - 1) / 2).cast("int")))).otherwise(s["found"])

    def step(s: Column, x: Column) -> Column:
        made = lambda before, first, begin, found: F.struct(before.alias("before"), first.alias("first"), x.alias("value"), begin.alias("begin"), (s["at"] + 1).alias("at"), found.alias("found"))
        return F.when(s["value"].isNull(), made(F.lit(-1.0), x, F.lit(0), s["found"])).when(same(x, s["first"]), made(s["before"], s["first"], s["begin"], s["found"])).otherwise(made(s["value"], x, s["at"], peak(s, x)))

    return F.aggregate(F.transform(values, double), start, step, lambda s: F.when(s["value"].isNull(), s["found"]).otherwise(peak(s, F.lit(-1.0))))
