import math
import random

import pytest

from quartzframe.operators.rescues import Limits, rescued_choice

SCALE = 500.0
SCHEMA = "image string, candidate string, corners array<double>, score double, exterior double, prior double, seeds array<string>, groups array<string>, n_seeds int, n_groups int"
TRUTH = [30, 20, 370, 20, 370, 280, 30, 280]
LARGE = [18, 14, 382, 14, 382, 286, 18, 286]
INNER = [125, 105, 275, 105, 275, 195, 125, 195]
FAR = [150, 120, 250, 120, 250, 180, 150, 180]


def row(image, name, corners, score, exterior=0.5, prior=0.5, seeds=None, groups=None, n_seeds=None, n_groups=None):
    return (image, name, list(map(float, corners)), score, exterior, prior, seeds, groups, n_seeds, n_groups)


def moved(corners, by):
    return [x + by * (i % 2 == 0) for i, x in enumerate(corners)]


def run(spark, edges, outside):
    e = spark.createDataFrame(edges, SCHEMA)
    o = spark.createDataFrame([(*r, k) for r, k in outside], SCHEMA + ", kind string")
    return {r["image"]: r.asDict() for r in rescued_choice(e, o, "image", "candidate", SCALE).collect()}


def dist(a, b):
    return max(math.dist(a[i : i + 2], b[i : i + 2]) for i in (0, 2, 4, 6)) / SCALE


def by_hand(edges, peer, mask, m=Limits()):
    """The rules one by one over lists; rows are dicts with lists of ids."""
    edges = sorted(edges, key=lambda r: (-r["score"], r["id"]))
    if not edges:
        one = peer or mask
        return (one["id"], "v7_only" if peer else "mask_only", None, None, None, None, 0, 0, 0)

    def grow(first, rest):
        group = [first]
        for r in rest:
            if all(dist(r["corners"], g["corners"]) <= m.cluster for g in group):
                group.append(r)
        return group

    def support(group):
        return len({s for r in group for s in r["seeds"]}), len({s for r in group for s in r["groups"]})

    def strong(s):
        return s[0] >= m.seeds and s[1] >= m.groups

    base = pick = edges[0]
    reason = "edge_base"
    fair = [r for r in edges if strong(support([r])) and r["exterior"] + m.tolerance >= base["exterior"]]
    if fair and not strong(support([base])):
        pick = min(fair, key=lambda r: (-len(r["groups"]), -len(r["seeds"]), -r["exterior"], -r["score"], r["id"]))
        reason = "edge_seed_support_rescue"
    rest, groups = edges, []
    while rest:
        groups.append(grow(rest[0], rest[1:]))
        rest = [r for r in rest if r not in groups[-1]]
    fair = [g for g in groups if strong(support(g)) and g[0]["exterior"] + m.tolerance >= base["exterior"]]
    if pick is base and fair and not strong(support(groups[0])):
        pick = min(fair, key=lambda g: (-support(g)[1], -support(g)[0], -g[0]["exterior"], -g[0]["score"], g[0]["id"]))[0]
        reason = "edge_cluster_support_rescue"
    if peer:
        far = dist(pick["corners"], peer["corners"])
        near = min(edges, key=lambda r: (dist(r["corners"], peer["corners"]), r["id"]))
        close = dist(near["corners"], peer["corners"])
        if far >= m.apart and close <= m.agree and far >= m.agree_ratio * max(close, 1e-6):
            pick, reason = near, "v7_edge_agreement_rescue"
    if peer and mask:
        ep, em, pm = (dist(a["corners"], b["corners"]) for a, b in ((pick, peer), (pick, mask), (peer, mask)))
        if pm <= m.outside_agree and min(ep, em) >= m.outside_ratio * max(pm, 1e-6) and peer["exterior"] - pick["exterior"] >= m.advantage:
            pick, reason = peer, "v7_mask_consensus_rescue"
        elif em <= m.mask_agree and min(ep, pm) >= m.mask_ratio * max(em, 1e-6) and pick["prior"] <= m.most_prior:
            pick, reason = mask, "edge_mask_consensus_rescue"
    group = grow(pick, [r for r in edges if r["id"] != pick["id"]])
    other = next((r for r in edges if r["id"] not in {g["id"] for g in group}), None)
    return (pick["id"], reason, base["id"], other and other["id"], other and dist(other["corners"], pick["corners"]), other and pick["score"] - other["score"], len(group), *support(group))


def test_each_rescue(spark):
    one, two = dict(seeds=["a"], groups=["g"]), dict(seeds=["a", "b"], groups=["g", "h"])
    edges = [
        row("base", "large", LARGE, 0.9, **two), row("base", "inner", INNER, 0.3),
        row("seeds", "large", LARGE, 0.9, n_seeds=1, n_groups=1), row("seeds", "multi", TRUTH, 0.6, n_seeds=3, n_groups=2),
        row("cluster", "large", LARGE, 0.9, seeds=["o"], groups=["f"]), row("cluster", "a", TRUTH, 0.6, **one), row("cluster", "b", moved(TRUTH, 1), 0.5, seeds=["b"], groups=["h"]),
        row("nearest", "large", LARGE, 0.9), row("nearest", "physical", TRUTH, 0.6), row("nearest", "inner", INNER, 0.4),
        row("peer", "inner", INNER, 0.5, exterior=0.2),
        row("mask", "near", moved(TRUTH, 2), 0.8, prior=0.0), row("mask", "inner", INNER, 0.4, prior=1.0),
        row("within", "a", TRUTH, 0.9, **one), row("within", "b", moved(TRUTH, 1), 0.8, seeds=["b"], groups=["h"]),
        row("gone", "x", TRUTH, 0.9)[:2] + (None,) + row("gone", "x", TRUTH, 0.9)[3:],
    ]
    outside = [
        (row("nearest", "v7", TRUTH, 0.5), "v7"), (row("peer", "v7", TRUTH, 0.5, exterior=0.9), "v7"), (row("peer", "mask", moved(TRUTH, 1), 0.5), "mask"),
        (row("mask", "v7", FAR, 0.5), "v7"), (row("mask", "mask", TRUTH, 0.5), "mask"), (row("only", "v7", TRUTH, 0.5), "v7"), (row("masked", "mask", TRUTH, 0.5), "mask"),
    ]
    got = run(spark, edges, outside)
    assert {k: (r["candidate"], r["reason"], r["base"]) for k, r in got.items()} == {
        "base": ("large", "edge_base", "large"),
        "seeds": ("multi", "edge_seed_support_rescue", "large"),
        "cluster": ("a", "edge_cluster_support_rescue", "large"),
        "nearest": ("physical", "v7_edge_agreement_rescue", "large"),
        "peer": ("v7", "v7_mask_consensus_rescue", "inner"),
        "mask": ("mask", "edge_mask_consensus_rescue", "near"),
        "within": ("a", "edge_base", "a"),
        "only": ("v7", "v7_only", None),
        "masked": ("mask", "mask_only", None),
    }
    assert (got["within"]["size"], got["within"]["seeds"], got["within"]["groups"], got["within"]["rival"]) == (2, 2, 2, None)
    assert got["base"]["rival"] == "inner" and got["base"]["rival_distance"] > 0.03 and math.isclose(got["base"]["margin"], 0.6)
    assert (got["only"]["size"], got["only"]["rival"]) == (0, None)


@pytest.mark.parametrize("seed", range(2))
def test_against_rules_by_hand(spark, seed):
    rng = random.Random(seed)
    edges, outside, want = [], [], {}

    def near(corners, spread):
        return [x + rng.uniform(-spread, spread) for x in corners]

    def made(image, name):
        ids = lambda: rng.sample("abcdefg", rng.randint(1, 2))
        shape = near(rng.choice([TRUTH, LARGE, INNER, TRUTH]), rng.choice([1, 3, 12]))
        return row(image, name, shape, round(rng.random(), 1), round(rng.uniform(0.2, 0.6), 2), rng.choice([0.0, 0.05, 0.8]), sorted(ids()), sorted(ids()))

    def named(r):
        return dict(zip(("image", "id", "corners", "score", "exterior", "prior", "seeds", "groups"), r))

    for i in range(250):
        image = f"i{i}"
        of_image = [made(image, f"e{k}") for k in range(rng.randint(0 if i % 10 == 0 else 1, 9))]
        peer, mask = (made(image, k) if rng.random() < 0.85 else None for k in ("v7", "mask"))
        if peer and mask and rng.random() < 0.5:
            mask = mask[:2] + (near(peer[2], 1),) + mask[3:]
        if of_image or peer or mask:
            edges += of_image
            outside += [(r, k) for r, k in ((peer, "v7"), (mask, "mask")) if r]
            want[image] = by_hand(list(map(named, of_image)), peer and named(peer), mask and named(mask))
    got = run(spark, edges, outside)
    names = ("candidate", "reason", "base", "rival", "rival_distance", "margin", "size", "seeds", "groups")
    assert set(got) == set(want)
    for image, w in want.items():
        assert tuple(got[image][n] for n in names) == pytest.approx(w, abs=1e-12), image
    assert len({w[1] for w in want.values()}) >= 6


def test_empty(spark):
    assert run(spark, [], []) == {}
