"""Selection over candidates of an image: seeds, ranked shortlists with supplements, nested candidates, support of clusters, permits."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k


def seeds(rows: DataFrame, by: list[str], candidate: str, position: str, eligible: Column, most: int = 8) -> DataFrame:
    """The first ``most`` eligible candidates of a group in the order given (ties by id), each once, with their place."""
    fit = rows.where(eligible)
    others = [c for c in fit.columns if c not in (*by, candidate)]
    once = fit.groupBy(*by, candidate).agg(F.min_by(F.struct(*others), position).alias("_row"))
    return top_k(once.select(*by, candidate, *[F.col(f"_row.{c}").alias(c) for c in others]), by, [F.col(position), F.col(candidate)], most, "place")


def ranked_with_supplements(rows: DataFrame, by: list[str], score: Column, rank: Column, candidate: str, supplement: Column, regular: int = 5, extra: int = 3) -> DataFrame:
    """The best ``regular`` candidates of a group and, behind them, its best ``extra`` supplements, with their places."""
    marked = rows.withColumn("_extra", supplement).withColumn("_score", score).withColumn("_rank", rank)
    best = top_k(marked, [*by, "_extra"], [F.col("_score").desc(), F.col("_rank"), F.col(candidate)], max(regular, extra), "_place")
    kept = best.where(F.when(F.col("_extra"), F.col("_place") <= extra).otherwise(F.col("_place") <= regular))
    return kept.withColumn("place", F.struct("_extra", "_place")).select(*rows.columns, F.col("place._extra").alias("supplement"), F.col("place._place").alias("place"))


def area(quad: str) -> Column:
    """Area of a quad of eight columns (prefix, x or y, number)."""
    at = lambda v, i: F.col(f"{quad}{v}{i % 4}")
    return F.abs(functools.reduce(operator.add, [at("x", i) * at("y", i + 1) - at("x", i + 1) * at("y", i) for i in range(4)])) / 2


def contained(outer: str, inner: str, slack: float = 1e-3) -> Column:
    """Whether all corners of a quad lie inside a convex one, whichever way that turns.

    Quads are eight columns each (prefix, x or y, number), so that the products are plain arithmetic in generated code.
    """
    at = lambda q, v, i: F.col(f"{q}{v}{i % 4}")
    side = lambda p, i: (at(outer, "x", i + 1) - at(outer, "x", i)) * (at(inner, "y", p) - at(outer, "y", i)) - (at(outer, "y", i + 1) - at(outer, "y", i)) * (at(inner, "x", p) - at(outer, "x", i))
    every = lambda p, holds: functools.reduce(operator.and_, [holds(side(p, i)) for i in range(4)])
    return functools.reduce(operator.and_, [every(p, lambda s: s >= -slack) | every(p, lambda s: s <= slack) for p in range(4)])


def nested(rows: DataFrame, by: list[str], candidate: str, corners: str, score: str, share: float = 0.9) -> DataFrame:
    """Rows (by, candidate, nested, nested_score): whether a clearly smaller candidate lies inside, and the best score of those.

    Candidates of an image meet in a join on the image; each pair is reduced at once, before the next shuffle.
    """
    numbers = lambda q: [F.get(F.col(corners), F.lit(i))[v].alias(f"_{q}{v}{i}") for i in range(4) for v in "xy"]
    a = rows.select(*by, F.col(candidate).alias("_a"), *numbers("a"))
    b = rows.select(*by, F.col(candidate).alias("_b"), F.greatest(F.lit(0.0), F.col(score)).alias("_score"), *numbers("b"))
    found = a.join(b, by).where((F.col("_a") != F.col("_b")) & (area("_b") < area("_a") * share) & contained("_a", "_b"))
    best = found.groupBy(*by, F.col("_a").alias(candidate)).agg(F.max("_score").alias("nested_score"))
    return rows.select(*by, candidate).join(best, [*by, candidate], "left").select(*by, candidate, F.col("nested_score").isNotNull().alias("nested"), F.coalesce("nested_score", F.lit(0.0)).alias("nested_score"))


def cluster_support(members: DataFrame, by: list[str], seed_ids: str, sources: str) -> DataFrame:
    """Rows (by, seeds, sources): how many different seeds and sources stand behind a cluster's members."""
    one = lambda c, name: members.select(*by, F.explode(c).alias("_v")).groupBy(*by).agg(F.count_distinct("_v").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return members.select(*by).distinct().join(one(seed_ids, "seeds"), by, "left").join(one(sources, "sources"), by, "left").select(*by, zero("seeds"), zero("sources"))


def permitted(requests: DataFrame, events: DataFrame, identity: list[str], annotation: str, corners: str, kind: str = "event_type", phase: str = "transaction_phase") -> DataFrame:
    """Requests for which a committed confirmation has the same identity, annotation and corners."""
    done = events.where((F.col(kind) == "confirmation") & (F.col(phase) == "FEEDBACK_COMMITTED")).alias("e")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*identity, corners)]
    match = F.col(f"r.{annotation}") == F.col(f"e.{annotation}")
    for s in same:
        match = match & s
    return requests.alias("r").join(done, match, "left_semi")


def blinded(rows: DataFrame, allowed: tuple[str, ...] = ("image_id", "origin_group_id", "arm_pseudonym", "stratum", "initial_corners", "risks")) -> DataFrame:
    """Only the columns that a reviewer may see."""
    return rows.select(*[c for c in rows.columns if c in allowed])


def run_identity(ids: DataFrame, id_column: str, split: str) -> DataFrame:
    """One row (split, n, ids_hash) that names an evaluated set whatever the order of its ids; only train and validation may
    be evaluated. Sum and exclusive or of the ids' hashes are combined before the shuffle, so no list of all ids is made."""
    if split not in ("train", "validation"):
        raise PermissionError("only train and validation may be evaluated")
    number = F.conv(F.substring(F.sha2(F.col(id_column).cast("string"), 256), 1, 15), 16, 10).cast("long")
    sums = ids.select(number.alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).alias("_sum"), F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("_xor"))
    return sums.select(F.lit(split).alias("split"), "n", F.sha2(F.concat_ws(":", F.lit(split), "n", "_sum", "_xor"), 256).alias("ids_hash"))
