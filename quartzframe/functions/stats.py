"""Order statistics, clamps and learned scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_at(values: Column, position: Column) -> Column:
    """Element of the sorted array, counted from 1."""
    return F.element_at(F.array_sort(values), position.cast("int"))


def nearest_rank(values: Column, share: float) -> Column:
    """The least element with at least ``share`` of the others at or below it; null for an empty array."""
    n = F.size(values)
    return F.when(n > 0, sorted_at(values, F.greatest(F.lit(1), F.least(n, F.ceil(n * share)))))


def higher_quantile(values: Column, share: float) -> Column:
    """The quantile that rounds the position among n - 1 steps up; null for an empty array."""
    n = F.size(values)
    return F.when(n > 0, sorted_at(values, F.ceil((n - 1) * share) + 1))


def finite(value: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def within(value: Column, low: Column, high: Column) -> Column:
    """The value held between two bounds; null stays null, which ``least`` and ``greatest`` alone would turn into a bound."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def clamped_number(value: Column, default: float = 0.0, limit: float = 20.0) -> Column:
    """The value within +-``limit``, ``default`` where it is missing or not finite."""
    return F.coalesce(within(finite(value), F.lit(-limit), F.lit(limit)), F.lit(default))


def first_finite(*values: Column) -> Column:
    return F.coalesce(*[finite(v) for v in values], F.lit(0.0))


def linear_score(features: Column, means: list[float], scales: list[float], weights: list[float], intercept: float) -> Column:
    """Standardised dot product; the coefficients are literals, so the expression stays in the JVM."""
    known = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(w).alias("w")) for m, s, w in zip(means, scales, weights, strict=True)])
    terms = F.zip_with(features, known, lambda x, k: (x - k["m"]) / k["s"] * k["w"])
    return F.aggregate(terms, F.lit(float(intercept)), lambda a, t: a + t)


def logistic(score: Column, temperature: float = 1.0, limit: float = 60.0) -> Column:
    """Probability of a score, held within +-``limit`` before the exponential; null for a missing score."""
    z = within(score / temperature, F.lit(-limit), F.lit(limit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def min_max(value: Column, low: Column, high: Column, flat: float = 0.5, tiny: float = 1e-12) -> Column:
    """Value between 0 and 1 by its range, ``flat`` where the range is (almost) nothing."""
    return F.when(high - low < tiny, F.lit(flat)).otherwise((value - low) / (high - low))


def needed(count: Column, share: float) -> Column:
    """Least whole number that is at least ``share`` of ``count``."""
    return F.ceil(count * F.lit(share))


def discordant_lower_bound(estimate: Column, improved: Column, worsened: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a paired difference from its discordant pairs."""
    return estimate - F.lit(z) * F.sqrt((improved + worsened) / (n * n))


def half_even(value: float) -> int:
    """Whole number nearest to ``value``, ties to even."""
    low = math.floor(value)
    rest = value - low
    return int(low if rest < 0.5 or rest == 0.5 and low % 2 == 0 else low + 1)
