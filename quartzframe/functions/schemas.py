"""Schemas of detection records, and what their values must fulfil."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORNERS = T.ArrayType(T.ArrayType(T.DoubleType()))
TEXTS, NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


IDENTITY = struct(**dict.fromkeys(("request_id", "image_id", "orientation_transform", "algorithm_version", "parameter_sha256", "mode"), T.StringType()))
AUDIT = struct(
    candidate_id=T.StringType(), sources=TEXTS, original_legal_corners=CORNERS, pre_topk_corners=CORNERS, proposed_refined_corners=CORNERS, adopted_refined_corners=CORNERS,
    pre_truncation_risk_decisions=TEXTS, pre_truncation_risk_evidence=T.MapType(T.StringType(), T.StringType()), stage_scores=T.MapType(T.StringType(), T.DoubleType()),
    stage_ranks=T.MapType(T.StringType(), T.IntegerType()), truncation_stage=T.StringType(), truncation_reason=T.StringType(),
)
RESULT = struct(
    identity=IDENTITY, status=T.StringType(), corners=CORNERS, alternate_corners=CORNERS, overall_confidence=T.DoubleType(), edge_confidences=NUMBERS, corner_confidences=NUMBERS,
    risks=TEXTS, top1_sources=TEXTS, alternate_sources=TEXTS, candidate_audit=T.ArrayType(AUDIT), timings_ms=T.MapType(T.StringType(), T.DoubleType()), debug=T.MapType(T.StringType(), T.StringType()), error=T.StringType(),
)
PROVIDER = struct(provider=T.StringType(), candidates=T.ArrayType(AUDIT), status=T.StringType(), elapsed_ms=T.DoubleType(), work_consumed=T.LongType(), work_limit=T.LongType())
MODES = ("safe", "aggressive")


def filled(value: Column) -> Column:
    """Whether a text has more than white space of any kind."""
    return F.coalesce(value.rlike(r"(?U)\S"), F.lit(False))


def share(values: Column) -> Column:
    """Whether all of some numbers lie between 0 and 1."""
    return F.coalesce(F.forall(values, lambda v: v.between(0.0, 1.0) & ~F.isnan(v)), F.lit(True))


def identity_rules(i: Column) -> list[tuple[str, Column]]:
    texts = [(n, filled(i[n])) for n in ("request_id", "image_id", "orientation_transform", "algorithm_version")]
    return [*texts, ("parameter_sha256", F.coalesce(i["parameter_sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False))), ("mode", F.coalesce(i["mode"].isin(*MODES), F.lit(False)))]


def audit_rules(a: Column) -> list[tuple[str, Column]]:
    four = lambda q: F.coalesce((F.size(q) == 4) & F.forall(q, lambda p: F.size(p) == 2), F.lit(False))
    rest = [(n, a[n].isNull() | four(a[n])) for n in ("pre_topk_corners", "proposed_refined_corners", "adopted_refined_corners")]
    return [("candidate_id", filled(a["candidate_id"])), ("sources", F.coalesce(F.forall(a["sources"], lambda s: F.length(s) > 0), F.lit(False))), ("original_legal_corners", four(a["original_legal_corners"])), *rest]


def result_rules(r: Column, statuses: tuple[str, ...]) -> list[tuple[str, Column]]:
    whole = r["overall_confidence"].isNull() | share(F.array(r["overall_confidence"]))
    return [("status", F.coalesce(r["status"].isin(*statuses), F.lit(False))), ("overall_confidence", whole), ("edge_confidences", share(r["edge_confidences"])), ("corner_confidences", share(r["corner_confidences"]))]
