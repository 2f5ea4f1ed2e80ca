"""Ordered decision tables: the first rule that applies gives outcome and reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geometry as g


@dataclass(frozen=True)
class Case:
    """A rule: when ``when`` is true (null is false), the row ends in ``outcome`` for ``reason``."""

    when: Column
    outcome: str
    reason: str


def decide(cases: list[Case], outcome: str, reason: str) -> Column:
    """Struct (outcome, reason) of the first case that applies, else the given one."""
    make = lambda o, r: F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))
    out = make(outcome, reason)
    for c in reversed(cases):
        out = F.when(F.coalesce(c.when, F.lit(False)), make(c.outcome, c.reason)).otherwise(out)
    return out


TERMINAL = ("cancelled", "error", "stale")
SAFE, AGGRESSIVE = 0.85, 0.65


def agreement(a: Column, b: Column, width: Column, height: Column, limit: float = 0.02) -> Column:
    """Corners agree on average, each coordinate as a share of the picture's extent."""
    part = lambda p, q: F.hypot((p["x"] - q["x"]) / (width - 1), (p["y"] - q["y"]) / (height - 1))
    return F.coalesce(g.total(F.zip_with(a, b, part)) / F.size(a) <= limit, F.lit(False))


def strong_evidence(success: Column, legal: Column, scores: Column, mean: float = 0.7, least: float = 0.5) -> Column:
    """A successful, legal result whose four scores are in range, high on average and none low."""
    usable = (F.size(scores) == 4) & F.forall(scores, lambda s: s.between(0, 1))
    return F.coalesce(success & legal & usable & (g.total(scores) / 4 >= mean) & (F.array_min(scores) >= least), F.lit(False))


def choose_detector(status: Column, legal: Column, confidence: Column, hard_risks: Column, legacy_run: Column, agrees: Column, legacy_strong: Column) -> Column:
    """Accept the first result, ask for the second, accept that, or leave it to a person."""
    safe = legal & (confidence >= SAFE) & ~hard_risks
    weak = confidence.isNull() | (confidence < AGGRESSIVE) | hard_risks
    return decide(
        [
            Case(status.isin(*TERMINAL), "manual_review", "terminal_status"),
            Case(status == "no_photo_evidence", "manual_review", "no_photo_evidence"),
            Case(safe, "accept_first", "safe"),
            Case(~legacy_run, "run_second", "low_confidence"),
            Case(legal & agrees, "accept_first", "cross_agreement"),
            Case(legacy_strong & weak, "accept_second", "strong_evidence"),
        ],
        "manual_review",
        "cross_conflict",
    )


def gate_action(status: Column, better: Column, harmful: Column, safe: Column, agreement_ratio: Column, thresholds: dict[str, float]) -> Column:
    """What to do with a proposal by three probabilities and the agreement of views: automatic results may be replaced,
    manual ones rescued; otherwise either is kept."""
    automatic, manual = status.isin("automatic", "v7_fallback"), status == "manual_review"
    usable = agreement_ratio >= thresholds["agreement"]
    return decide(
        [
            Case(automatic & usable & (better >= thresholds["better"]) & (harmful <= thresholds["harmful"]), "replace_automatic", "better"),
            Case(manual & usable & (safe >= thresholds["safe"]) & (harmful <= thresholds["harmful_rescue"]), "rescue_manual", "safe"),
            Case(manual, "keep_manual", "kept"),
        ],
        "keep_current",
        "kept",
    )
