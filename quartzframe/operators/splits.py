"""Deterministic dataset splits, group splits, lineage and attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import hash_bucket, hash_fraction


def stable_split(rows: DataFrame, key: str, salt: str, version: str, train: int = 70, validation: int = 15) -> DataFrame:
    """Adds ``split``: by the key's hash bucket of 100, train below 70, validation below 85, then frozen_test."""
    bucket = hash_bucket(F.col(key), salt, version)
    return rows.withColumn("split", F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("frozen_test"))


def extend_split(existing: DataFrame, rows: DataFrame, key: str, salt: str, version: str) -> DataFrame:
    """Keeps existing assignments and adds those of new keys."""
    new = rows.select(key).distinct().join(existing.select(key), key, "left_anti")
    return existing.select(key, "split").unionByName(stable_split(new, key, salt, version))


def fraction_split(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Adds ``split``: validation where the key's hash fraction lies below ``share``, else train."""
    return rows.withColumn("split", F.when(hash_fraction(F.col(key)) < share, "validation").otherwise("train"))


def group_split(rows: DataFrame, group: str, seed: int, share: float) -> DataFrame:
    """Rows (group, subset): distinct groups by hash, the first ones calibration and the rest fit.

    The number of calibration groups is rounded half to even and leaves at least one group on
    each side. Groups are ranked in one task: they are few against rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256)
    groups = rows.select(group).distinct().withColumn("_digest", digest)
    ranked = groups.select(group, F.row_number().over(Window.orderBy("_digest", group)).alias("_rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    size = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(share), 0).cast("int")))
    return ranked.select(group, F.when(F.col("_rank") <= size, "calibration").otherwise("fit").alias("subset"))


def lineage(rows: DataFrame, key: str, subset: str, copies: int, seed: int) -> DataFrame:
    """A real row for each sample and ``copies`` synthetic ones for each fit sample, with hashed ids and seeds."""
    real = rows.select(F.col(key), F.lit("real").alias("kind"), F.lit(-1).alias("copy"))
    made = rows.where(F.col(subset) == "fit").select(F.col(key), F.lit("synthetic").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("kind"), F.col("copy")), 256)
    return real.unionByName(made).withColumn("lineage_id", F.substring(digest, 1, 24)).withColumn("draw_seed", F.conv(F.substring(digest, 25, 8), 16, 10).cast("long"))


def same_members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows (key, side) of ids that only one side has; empty when the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def attestation(rows: DataFrame, group: str, slices: str) -> DataFrame:
    """Rows (slice, samples, groups): for each slice and, under a null slice, for all rows."""
    each = rows.select(group, F.explode(slices).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(group).alias("groups"))
    return each.unionByName(rows.agg(F.lit(None).cast("string").alias("slice"), F.count(F.lit(1)).alias("samples"), F.count_distinct(group).alias("groups")))
