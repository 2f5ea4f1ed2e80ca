"""One candidate an image, from edge candidates and two outside proposals: the best by score, unless an ordered chain of rescues replaces it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .ranking import complete_link_clusters

#: The two outside proposals, and what a choice is said to come from.
PEER, MASK = "v7", "mask"
BASE, SUPPORTED, UNITED, NEAREST, PEER_AGREES, MASK_AGREES = (
    "edge_base", "edge_seed_support_rescue", "edge_cluster_support_rescue", "v7_edge_agreement_rescue", "v7_mask_consensus_rescue", "edge_mask_consensus_rescue",
)
FIELDS = ("corners", "score", "exterior", "prior", "seeds", "groups", "n_seeds", "n_groups")
TINY = 1e-6


@dataclass(frozen=True)
class Limits:
    """Distances as shares of the diagonal, ratios of distances, scores, and the least numbers of seeds and of their groups."""

    apart: float = 0.02
    agree: float = 0.02
    agree_ratio: float = 4.0
    outside_agree: float = 0.01
    outside_ratio: float = 1.25
    advantage: float = 0.05
    mask_agree: float = 0.03
    mask_ratio: float = 3.0
    most_prior: float = 0.10
    tolerance: float = 0.10
    cluster: float = 0.012
    seeds: int = 2
    groups: int = 2


def corner_gap(a: Column, b: Column, scale: float) -> Column:
    """Largest distance of two quads' corners, arrays x1, y1 .. x4, y4, as a share of ``scale``."""
    return F.greatest(*[F.sqrt((a[i] - b[i]) * (a[i] - b[i]) + (a[i + 1] - b[i + 1]) * (a[i + 1] - b[i + 1])) for i in (0, 2, 4, 6)]) / scale


def _distinct(lists: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(lists)))


def _prepared(rows: DataFrame, candidate: str) -> DataFrame:
    """With ``seeds`` and ``groups`` made up where there are none, from the counts, which are 1 by default."""
    for ids, n, word in (("seeds", "n_seeds", "implicit-seed"), ("groups", "n_groups", "implicit-source")):
        size = F.when(F.col(ids).isNotNull(), F.size(ids))
        given = F.coalesce(F.col(n).cast("int"), size, F.lit(1)) if n in rows.columns else F.coalesce(size, F.lit(1))
        made = F.transform(F.sequence(F.lit(0), given - 1), lambda i, word=word: F.concat_ws(":", F.col(candidate), F.lit(word), i.cast("string")))
        rows = rows.withColumn(ids, F.coalesce(F.col(ids), made)).withColumn(n, F.size(ids))
    return rows


def rescued_choice(edges: DataFrame, outside: DataFrame, by: str, candidate: str, scale: float, limits: Limits | None = None) -> DataFrame:
    """Rows (by, candidate, corners, score, reason, base, rival, rival_distance, margin, size, seeds, groups), one an image.

    Both tables have (by, candidate, corners, score, exterior, prior, seeds, groups); ``corners`` are arrays of eight numbers in pixels and ``scale``
    is the diagonal. ``seeds`` and ``groups`` are lists of ids; a null list stands for ids of the row's own, as many as ``n_seeds`` or ``n_groups`` says (1 without these).
    ``outside`` has a column ``kind`` too, "v7" or "mask", with at most a row of each an image; of more, the best counts. Ids are unique in an image.

    The best edge candidate is the base. In this order, each rescue looks at what is chosen by then: a candidate whose seeds support it replaces
    a base without support; else the head of a cluster with support does, if base's cluster has none; the edge candidate nearest to the peer
    replaces one that is far from it; the peer, or else the mask, replaces one that is the odd one out of three. The rival is the best edge
    candidate outside the chosen one's cluster, whose size and different seeds and groups are told. Without edge candidates the peer, or else the mask, is chosen and nothing is told.
    Rows without an image or corners are left out; empty tables give no rows. Clusters are found image by image, all else by aggregates that combine before the shuffle.
    """
    m = limits or Limits()
    edges, outside = (_prepared(t.where(F.col(by).isNotNull() & F.col("corners").isNotNull()), candidate) for t in (edges, outside))
    body = F.struct(F.col(candidate).alias("id"), *FIELDS)
    ranked = F.struct((-F.col("score")).alias("order"), F.col(candidate).alias("id"), body.alias("body"))
    gap = lambda a, b: corner_gap(a["corners"], b["corners"], scale)
    weak = lambda seeds, groups: (seeds < m.seeds) | (groups < m.groups)
    c = F.col

    # a row an image: base and outside proposals
    base = edges.groupBy(by).agg(F.min(ranked)["body"].alias("base"))
    sides = outside.groupBy(by).agg(*[F.min(F.when(c("kind") == k, ranked))["body"].alias(k) for k in (PEER, MASK)])
    images = base.join(sides, by, "full")

    # what may replace it: a supported candidate, a supported cluster's head, the peer's nearest
    good = lambda exterior: exterior + m.tolerance >= c("base")["exterior"]
    single = F.struct((-c("n_groups")).alias("a"), (-c("n_seeds")).alias("b"), (-c("exterior")).alias("c"), (-c("score")).alias("d"), c(candidate).alias("e"), body.alias("body"))
    near = F.struct(corner_gap(c("corners"), c(PEER)["corners"], scale).alias("a"), c(candidate).alias("b"), body.alias("body"))
    met = edges.join(images, by).groupBy(by).agg(
        F.min(F.when(~weak(c("n_seeds"), c("n_groups")) & good(c("exterior")), single))["body"].alias("single"),
        F.min(F.when(c(PEER).isNotNull(), near))["body"].alias("near"),
    )
    order = edges.select(by, candidate, "corners", (-c("score")).alias("_order"))
    parts = complete_link_clusters(order, by, candidate, ["_order", candidate], "corners", scale, m.cluster)
    united = edges.join(parts, [by, candidate]).groupBy(by, "cluster").agg(F.min(ranked)["body"].alias("head"), F.size(_distinct(c("seeds"))).alias("u_seeds"), F.size(_distinct(c("groups"))).alias("u_groups"))
    head = c("head")
    union = F.struct((-c("u_groups")).alias("a"), (-c("u_seeds")).alias("b"), (-head["exterior"]).alias("c"), (-head["score"]).alias("d"), head["id"].alias("e"), head.alias("body"))
    joined = united.join(base, by).groupBy(by).agg(
        F.min(F.when(~weak(c("u_seeds"), c("u_groups")) & good(head["exterior"]), union))["body"].alias("union"),
        F.max((c("cluster") == 0) & weak(c("u_seeds"), c("u_groups"))).alias("base_weak"),  # base is the first of the first cluster
    )

    # the chain: a place in the pool, which each rescue may change; gaps are found once
    pool = [c(x) for x in ("base", "single", "union", "near", PEER, MASK)]
    found = images.join(met, by, "left").join(joined, by, "left").select(
        by, "base_weak", F.array(*pool).alias("pool"), *[F.array(*[gap(x, c(k)) for x in pool]).alias(f"to_{k}") for k in (PEER, MASK)],
        F.when(c("base").isNotNull(), 0).when(c(PEER).isNotNull(), 4).otherwise(5).alias("place"),
        F.when(c("base").isNotNull(), BASE).when(c(PEER).isNotNull(), f"{PEER}_only").otherwise(f"{MASK}_only").alias("reason"),
    )
    at = lambda i: F.get("pool", F.lit(i) if isinstance(i, int) else i)
    to = lambda kind, i: F.get(f"to_{kind}", F.lit(i) if isinstance(i, int) else i)
    place, base_row, peer = c("place"), at(0), at(4)
    to_peer, to_mask, between, closest = to(PEER, place), to(MASK, place), to(MASK, 4), to(PEER, 3)
    floor = lambda x: F.greatest(x, F.lit(TINY))
    chain = [
        (SUPPORTED, 1, weak(base_row["n_seeds"], base_row["n_groups"]) & at(1).isNotNull()),
        (UNITED, 2, (place == 0) & c("base_weak") & at(2).isNotNull()),
        (NEAREST, 3, (to_peer >= m.apart) & (closest <= m.agree) & (to_peer >= m.agree_ratio * floor(closest))),
        (PEER_AGREES, 4, (between <= m.outside_agree) & (F.least(to_peer, to_mask) >= m.outside_ratio * floor(between)) & (peer["exterior"] - at(place)["exterior"] >= m.advantage)),
        (MASK_AGREES, 5, (place != 4) & (to_mask <= m.mask_agree) & (F.least(to_peer, between) >= m.mask_ratio * floor(to_mask)) & (at(place)["prior"] <= m.most_prior)),
    ]
    for reason, i, when in chain:
        found = found.withColumn("_hit", F.coalesce(base_row.isNotNull() & when, F.lit(False))).withColumns({"place": F.when(c("_hit"), i).otherwise(place), "reason": F.when(c("_hit"), reason).otherwise(c("reason"))})
    folder = scratch.shared_folder(edges.sparkSession, "rescued")  # clusters are found once, and filters stay above the chain
    found.select(by, at(place).alias("chosen"), "reason", base_row["id"].alias("base")).write.parquet(folder)
    found, chosen = edges.sparkSession.read.parquet(folder), c("chosen")

    # the chosen one's cluster, and the best outside it
    anchored = found.where("base IS NOT NULL")
    others = edges.join(anchored.select(by, "chosen"), by).where(c(candidate) != chosen["id"])
    around = others.where(corner_gap(c("corners"), chosen["corners"], scale) <= m.cluster).select(by, candidate, "corners", (-c("score")).alias("_order"))
    first = anchored.select(by, chosen["id"].alias(candidate), chosen["corners"].alias("corners"), F.lit(float("-inf")).alias("_order"))
    members = complete_link_clusters(around.unionByName(first), by, candidate, ["_order", candidate], "corners", scale, m.cluster).where("cluster = 0")
    inside = c("cluster").isNotNull()
    rest = others.join(members, [by, candidate], "left").groupBy(by).agg(
        F.min(F.when(~inside, ranked))["body"].alias("rival"), F.count(F.when(inside, 1)).alias("more"),
        *[_distinct(F.when(inside, c(x))).alias(f"more_{x}") for x in ("seeds", "groups")],
    )
    rival = c("rival")
    size = lambda x: F.when(c("base").isNotNull(), F.size(F.array_distinct(F.concat(chosen[x], F.coalesce(f"more_{x}", F.array().cast("array<string>")))))).otherwise(0)
    return found.join(rest, by, "left").select(
        by, chosen["id"].alias(candidate), chosen["corners"].alias("corners"), chosen["score"].alias("score"), "reason", "base",
        rival["id"].alias("rival"), gap(rival, chosen).alias("rival_distance"), (chosen["score"] - rival["score"]).alias("margin"),
        F.when(c("base").isNotNull(), 1 + F.coalesce("more", F.lit(0))).otherwise(0).cast("int").alias("size"), size("seeds").cast("int").alias("seeds"), size("groups").cast("int").alias("groups"),
    )
