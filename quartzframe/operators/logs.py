"""Event logs: the latest valid record of a key, revision chains, idempotent appends, reconciliation.

Log order is a position column, never a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregation, so rows combine before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*log.columns)


def chain_position(log: DataFrame, keys: list[str], order: list[str], id_column: str) -> DataFrame:
    """Adds each row's place in its chain, its predecessor's id and whether it is the head."""
    chain = Window.partitionBy(*keys).orderBy(*order)
    return log.select("*", F.row_number().over(chain).alias("position"), F.lag(id_column).over(chain).alias("previous_id"), F.lead(id_column).over(chain).isNull().alias("is_head"))


def chain_violations(log: DataFrame, id_column: str, target: str, key: str, position: str) -> DataFrame:
    """Rows (id, violation) of a log whose rows supersede earlier ones: duplicate ids, unknown, foreign or later targets,
    targets superseded twice, and keys with several heads. An empty result means a valid history."""
    ids = log.select(F.col(id_column).alias("_t"), F.col(key).alias("_key"), F.col(position).alias("_at"))
    duplicate = log.groupBy(id_column).count().where("count > 1").select(F.col(id_column).alias("id"), F.lit("duplicate_id").alias("violation"))
    pointed = log.where(F.col(target).isNotNull()).join(ids.dropDuplicates(["_t"]), F.col(target) == F.col("_t"), "left")
    wrong = F.when(F.col("_t").isNull(), "unknown_target").when(F.col("_key") != F.col(key), "cross_key_target").when(F.col("_at") >= F.col(position), "later_target")
    links = pointed.select(F.col(id_column).alias("id"), wrong.alias("violation")).where("violation is not null")
    branch = log.where(F.col(target).isNotNull()).groupBy(target).count().where("count > 1").select(F.col(target).alias("id"), F.lit("branch").alias("violation"))
    heads = log.join(log.select(F.col(target).alias("_s")).where("_s is not null").distinct(), F.col(id_column) == F.col("_s"), "left_anti")
    many = heads.groupBy(key).count().where("count > 1").select(F.col(key).cast("string").alias("id"), F.lit("several_heads").alias("violation"))
    return duplicate.unionByName(links).unionByName(branch).unionByName(many)


def active_heads(log: DataFrame, id_column: str, target: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = log.select(F.col(target).alias(id_column)).where(F.col(id_column).isNotNull()).distinct()
    return log.join(gone, id_column, "left_anti")


def dedup_by(log: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity: a repeated append collapses."""
    rest = [c for c in log.columns if c not in identity]
    first = log.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*identity, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*log.columns)


def append_new(stored: DataFrame, incoming: DataFrame, id_column: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append and conflicting rows: an id already stored is skipped if its payload is the same, else a conflict; so
    are rows of one id in the batch whose payloads differ."""
    once = incoming.dropDuplicates([id_column, *payload])
    twice = once.groupBy(id_column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_column)
    fresh = once.join(stored.select(id_column), id_column, "left_anti").join(twice, id_column, "left_anti")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in payload]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    clash = once.alias("i").join(stored.alias("s"), id_column).where(~equal).select("i.*")
    return fresh, clash.unionByName(once.join(twice, id_column, "left_semi")).dropDuplicates([id_column, *payload])


def reconcile(current: DataFrame, log: DataFrame, key: str, order: list[str], updates: dict[str, str]) -> DataFrame:
    """``current`` with the columns of ``updates`` (column: log column) taken from the key's latest event, if there is one."""
    latest = latest_by_key(log, [key], order).select(key, *[F.col(c).alias(f"_new_{k}") for k, c in updates.items()])
    joined = current.join(latest, key, "left")
    plain = [c for c in current.columns if c not in updates]
    return joined.select(*plain, *[F.coalesce(f"_new_{k}", k).alias(k) if k in current.columns else F.col(f"_new_{k}").alias(k) for k in updates])


def routed_union(base: DataFrame, routed: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` for keys without a route, and rows of ``routed`` for keys with one."""
    return base.join(routes.select(key), key, "left_anti").unionByName(routed.join(routes.select(key), key, "left_semi"))


def transaction_state(log: DataFrame, id_column: str, phase: str, phases: list[str]) -> DataFrame:
    """Furthest phase of each transaction and what recovery has to do with it."""
    rank: Column = F.lit(0)
    for i, name in enumerate(phases, 1):
        rank = F.when(F.col(phase) == name, i).otherwise(rank)
    last = log.groupBy(id_column).agg(F.max(rank).alias("_n"))
    names = F.array(F.lit(None).cast("string"), *[F.lit(p) for p in phases])
    action = F.when(F.col("_n") >= len(phases), "none").when(F.col("_n") >= 2, "complete").otherwise("abort")
    return last.select(id_column, F.get(names, F.col("_n")).alias("phase"), action.alias("recovery"))


def collapse_sources(images: DataFrame, key: str, source: list[str], metadata: list[str]) -> DataFrame:
    """One row a key with its distinct sources; keys with differing metadata are marked as conflicts."""
    kinds = F.count_distinct(F.struct(*metadata)) > 1
    return images.groupBy(key).agg(*[F.min(c).alias(c) for c in metadata], F.array_sort(F.collect_set(F.struct(*source))).alias("sources"), kinds.alias("conflict"))


def storage_preflight(sources: DataFrame, stored: DataFrame, key: str, size: str) -> DataFrame:
    """One row (new_objects, new_bytes): distinct contents that aren't stored yet."""
    new = sources.select(key, size).groupBy(key).agg(F.max(size).alias(size)).join(stored.select(key), key, "left_anti")
    return new.agg(F.count(F.lit(1)).alias("new_objects"), F.coalesce(F.sum(size), F.lit(0)).alias("new_bytes"))


def unique_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that keeps the right side only where exactly one row matches."""
    once = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys]).where("_n = 1").drop("_n")
    return left.join(once, keys, "left")
