"""Paired rates, candidate budgets, terminal states, gates, slices, study arms and bootstrap."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.stats import discordant_lower_bound, higher_quantile, nearest_rank, needed

def flag(column: str | Column) -> Column:
    """A strict boolean: null counts as false."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(False))


def paired_rate(rows: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Paired comparison of two flags: improved and worsened pairs, difference of rates, its lower bound and verdict."""
    pairs = rows.select(*(by or []), flag(a).alias("_a"), flag(b).alias("_b"))
    counts = pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_a").alias("hits_a"), F.count_if("_b").alias("hits_b"), F.count_if(F.col("_a") & ~F.col("_b")).alias("improved"), F.count_if(F.col("_b") & ~F.col("_a")).alias("worsened")
    )
    estimate = F.when(F.col("n") > 0, F.col("hits_a") / F.col("n") - F.col("hits_b") / F.col("n"))
    rated = counts.withColumn("estimate", estimate)
    rated = rated.withColumn("ci_lower", F.when(F.col("n") > 0, discordant_lower_bound(F.col("estimate"), F.col("improved"), F.col("worsened"), F.greatest("n", F.lit(1)))))
    return rated.withColumn("passed", flag(F.col("ci_lower") > 0)).drop("hits_a", "hits_b")


def budget_counts(rows: DataFrame, base: str, rank: str, other: str, subset: str, budgets: tuple[int, ...]) -> DataFrame:
    """Counts of base, ranked and other candidates, their union and unique gains, and the union at each budget, for
    all rows (null subset) and for each subset; one pass with grouping sets."""
    r = rows.select(F.col(subset).alias("subset"), flag(base).alias("_a"), F.col(rank).alias("_r"), flag(other).alias("_c")).withColumn("_b", F.col("_r").isNotNull())
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    measures = {"samples": F.count(F.lit(1)), "base": F.count_if(a), "ranked": F.count_if(b), "other": F.count_if(c), "any": F.count_if(a | b | c), "ranked_only": F.count_if(b & ~a), "other_only": F.count_if(c & ~a & ~b)}
    measures |= {f"within_{k}": F.count_if(a | c | flag(F.col("_r") <= k)) for k in budgets}
    out = r.rollup("subset").agg(F.grouping("subset").alias("_all"), *[m.alias(k) for k, m in measures.items()])
    out = out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("subset")).alias("subset"), *measures)
    return out.withColumn("gain", F.col("any") - F.col("base")).withColumn("rate", F.when(F.col("samples") > 0, F.col("any") / F.col("samples")).otherwise(0.0))


def feasibility_gate(counts: DataFrame, frozen_accessed: bool = False, modified: int = 0, least_rate: float = 0.95, least_gain: int = 30, subset: str = "calibration") -> DataFrame:
    """One row: verdict and failed conditions of budget counts."""
    one = counts.agg(
        *[F.max(F.when(F.col("subset") == s, F.col(c))).alias(f"_{k}_{c}") for k, s in enumerate(("all", subset)) for c in ("samples", "any", "gain")]
    )
    x = lambda s, c: F.coalesce(F.col(f"_{int(s != 'all')}_{c}"), F.lit(0))
    conditions = {
        "union_rate": x("all", "any") >= needed(x("all", "samples"), least_rate),
        "net_gain": x("all", "gain") >= least_gain,
        f"{subset}_union_rate": x(subset, "any") >= needed(x(subset, "samples"), least_rate),
        f"{subset}_net_gain": x(subset, "gain") > 0,
        "frozen_not_accessed": F.lit(not frozen_accessed),
        "source_unchanged": F.lit(modified == 0),
    }
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in conditions.items()]))
    return one.select(needed(x("all", "samples"), least_rate).alias("needed_union"), (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))


def terminal_summary(rows: DataFrame, status: str, strict: str, catastrophic: str) -> DataFrame:
    """One row of counts and rates over terminal states; the fallback counts as automatic, denominators are all rows. A state
    that is none of them raises."""
    auto = F.col(status).isin("automatic", "v7_fallback")
    known = F.coalesce(auto | F.col(status).isin("manual_review", "cancelled", "error"), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("not a terminal state: "), F.coalesce(F.col(status).cast("string"), F.lit("null")))).cast("int")
    out = rows.agg(
        F.count(F.when(known, F.lit(1)).otherwise(refused)).alias("samples"), F.count_if(auto).alias("automatic"), F.count_if(auto & flag(strict)).alias("strict"), F.count_if(auto & flag(catastrophic)).alias("catastrophic"),
        F.count_if(F.col(status).isin("manual_review", "cancelled", "error")).alias("manual"), F.count_if(F.col(status) == "v7_fallback").alias("fallback"),
    )
    rate = lambda c: F.when(F.col("samples") > 0, F.col(c) / F.col("samples")).otherwise(0.0)
    return out.withColumn("strict_rate", rate("strict")).withColumn("manual_rate", rate("manual"))


def terminal_gate(summary: DataFrame, least_strict: float = 0.95, most_manual: float = 0.05) -> DataFrame:
    """Verdict of a terminal summary with the thresholds as whole counts."""
    wanted, allowed = needed(F.col("samples"), least_strict), F.floor(F.col("samples") * F.lit(most_manual))
    checks = {"strict_rate": F.col("strict") >= wanted, "no_catastrophe": F.col("catastrophic") == 0, "manual_rate": F.col("manual") <= allowed}
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    return summary.select("samples", wanted.alias("needed_strict"), allowed.alias("allowed_manual"), (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))


def quad_errors(rows: DataFrame, predicted: Column, truth: Column, width: Column, height: Column) -> DataFrame:
    """Adds validity, nearest-rank p95, largest and mean error of the corners, the jitter count and strictness."""
    d = g.corner_distances(predicted, truth)
    return rows.select(
        "*", d.isNotNull().alias("valid"), nearest_rank(d, 0.95).alias("p95_px"), (F.array_max(d) / g.diagonal(width, height)).alias("max_normalized"), g.mean_corner_distance(predicted, truth, width, height).alias("mean_normalized"),
        g.moved_corners(predicted, truth, width, height).alias("moved"), g.is_strict(predicted, truth, width, height).alias("strict"),
    )


def work_summary(rows: DataFrame, extra: str, by: list[str] | None = None) -> DataFrame:
    """Activation rate, mean, p95 (position rounded up) and maximum of extra work.

    The quantile needs the sorted values of a group; values repeat, so groups are first counted by value.
    """
    counted = rows.groupBy(*(by or []), F.col(extra).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*(by or [])).orderBy("_v")
    every = Window.partitionBy(*(by or []))
    placed = counted.select("*", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(every).alias("_all"))
    reached = F.when(F.col("_upto") > F.ceil((F.col("_all") - 1) * F.lit(0.95)), F.col("_v"))
    mean = (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean")
    return placed.groupBy(*(by or [])).agg(F.sum("_n").alias("samples"), mean, (F.sum(F.when(F.col("_v") > 0, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("active_rate"), F.min(reached).alias("p95"), F.max("_v").alias("most"))


def derive_slices(labels: Column, q: Column, width: Column, height: Column) -> Column:
    """Sorted distinct labels: those given and those that the shape shows."""
    sides = g.edges(q)
    near = lambda v, n: (F.abs(v) <= 1) | (F.abs(v - (n - 1)) <= 1)
    seen = F.array(
        F.when(F.array_max(sides) / F.greatest(F.lit(1e-9), F.array_min(sides)) > 1.02, F.lit("perspective")),
        F.when(F.exists(g.turns(q), lambda v: v > 0) & F.exists(g.turns(q), lambda v: v < 0), F.lit("complex_texture")),
        F.when(F.exists(q, lambda p: near(p["x"], width) | near(p["y"], height)), F.lit("touches_border")),
    )
    extra = F.when(g.is_complete(q), F.array_compact(seen)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(labels, F.array().cast("array<string>")), extra)))


def study_arms(rows: DataFrame, sample: str, group: str, stratum: str, seed: int) -> DataFrame:
    """Rows (sample, group, stratum, arm): groups are shuffled inside each stratum and dealt to two arms in turn.

    One seeded generator runs over all strata in order, so the shuffle of the (few) groups is one
    task; samples are joined to the arms afterwards.
    """
    groups = rows.groupBy(F.col(group).alias("g")).agg(F.min(stratum).alias("s"), F.count_distinct(stratum).alias("_n"))
    checked = groups.select("g", F.when(F.col("_n") > 1, F.raise_error(F.lit("a group crosses strata"))).otherwise(F.col("s")).alias("s"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, out = random.Random(seed), []
        for name, part in sorted(pdf.groupby("s")):
            order = sorted(part["g"])
            rng.shuffle(order)
            out.extend((g_, name, "arm_a" if i % 2 == 0 else "arm_b") for i, g_ in enumerate(order))
        return pd.DataFrame(out, columns=["g", "s", "arm"])

    arms = checked.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(deal, "g string, s string, arm string")
    return rows.select(F.col(sample), F.col(group)).join(arms.withColumnRenamed("g", group), group).select(sample, group, F.col("s").alias("stratum"), "arm")


def bootstrap_delta(rows: DataFrame, a: str, b: str, by: str, seed: int = 0, repetitions: int = 2000) -> DataFrame:
    """Mean paired difference of each group and the lower end of its bootstrap.

    Rows are resampled, at least 100 times. Differences of flags take few values, so a group is
    reduced to their counts before the shuffle and a resample is one multinomial draw.
    """
    counts = rows.groupBy(by, (F.col(a).cast("double") - F.col(b).cast("double")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("delta")
        values, n = pdf["delta"].to_numpy(), pdf["n"].to_numpy()
        total = int(n.sum())
        means = np.sort(np.random.default_rng(seed).multinomial(total, n / total, max(100, repetitions)) @ values / total)
        lower = float(means[max(0, int(0.05 * len(means)))])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [total], "estimate": [float((values * n).sum() / total)], "ci_lower": [lower], "passed": [lower >= 0]})

    kind = dict(rows.dtypes)[by]
    return counts.groupBy(by).applyInPandas(draw, f"`{by}` {kind}, n long, estimate double, ci_lower double, passed boolean")


def p95_rules(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank and rounded-up p95 of each group (for groups that fit a row; see work_summary for others)."""
    values = F.collect_list(value)
    return rows.groupBy(*by).agg(nearest_rank(values, 0.95).alias("nearest"), higher_quantile(values, 0.95).alias("higher"))
