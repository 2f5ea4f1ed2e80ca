"""Scores in two stages: a cheap one for all candidates of a group, a costly one for those that it puts first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import within
from .ranking import top_k

#: As many candidates of a group get the costly score at most (a fixed value).
MOST = 5


def margins(rows: DataFrame, by: list[str], candidate: str, score: str) -> DataFrame:
    """Adds ``margin``: half, and five times what a score lies above the best other one of its group (0 if alone), between 0 and 1.

    A group's two best rows are found before the shuffle and are all that is joined back.
    """
    two = top_k(rows.select(*by, candidate, score), by, [F.col(score).desc(), F.col(candidate)], 2, "_place")
    first = lambda n, c: F.max(F.when(F.col("_place") == n, F.col(c)))
    best = two.groupBy(*by).agg(first(1, candidate).alias("_first"), first(1, score).alias("_best"), first(2, score).alias("_second"))
    other = F.coalesce(F.when(F.col(candidate) == F.col("_first"), F.col("_second")).otherwise(F.col("_best")), F.lit(0.0))
    margin = within(0.5 + (F.col(score) - other) * 5.0, F.lit(0.0), F.lit(1.0))
    return rows.join(best, by).withColumn("margin", margin).drop("_first", "_best", "_second")


def two_stage(rows: DataFrame, by: list[str], candidate: str, score: str, refined: Callable[[Column], Column], costly: Callable[[DataFrame], DataFrame], k: int = MOST) -> DataFrame:
    """Rows (by, candidate, pre_score, pre_rank, selected_rank, score, reason) of candidates with a cheap score.

    ``refined(margin)`` is the cheap score that ranks, by descending value and then by candidate. The first ``k`` (five at most) go through ``costly``,
    which adds ``full_score`` to whatever columns they have; the others keep their cheap score and get the reason ``topk_limit``. What is
    costly stands behind the limit in the plan, so it never sees the others.
    """
    key = [*by, candidate]
    ranked = margins(rows, by, candidate, score).withColumn("pre_score", refined(F.col("margin")))
    order = [F.col("pre_score").desc(), F.col(candidate)]
    chosen = costly(top_k(ranked, by, order, min(MOST, k), "selected_rank")).select(*key, "selected_rank", "full_score")
    places = ranked.select(*key, "pre_score", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("pre_rank"))
    full = places.join(chosen, key, "left")
    return full.select(*key, "pre_score", "pre_rank", "selected_rank", F.coalesce("full_score", "pre_score").alias("score"), F.when(F.col("selected_rank").isNull(), "topk_limit").alias("reason"))
