import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzframe.operators import ranking
from quartzframe.operators import robust, staged, structured


def numpy_line(points, base, way, rounds):
    """The fit as a loop over NumPy arrays."""
    weights = base.copy()
    for _ in range(rounds):
        anchor = (points * weights[:, None]).sum(axis=0) / weights.sum()
        centered = points - anchor
        values, vectors = np.linalg.eigh((centered * weights[:, None]).T @ centered / weights.sum())
        axis = vectors[:, int(np.argmax(values))]
        axis = -axis if axis @ way < 0 else axis
        far = np.abs(centered @ np.array([axis[1], -axis[0]]))
        scale = max(0.25, 1.4826 * np.median(far))
        weights = base * np.where(far > 1.5 * scale, 1.5 * scale / np.maximum(far, 1e-300), 1.0)
    return [*anchor, *axis, scale]


def test_robust_lines_with_outliers(spark):
    rng = np.random.default_rng(5)
    rows, ways, want = [], [], {}
    for k, (n, angle) in enumerate([(200, 0.3), (51, 1.5), (80, -2.0), (2, 0.7), (40, math.pi / 2), (30, 0.0)]):
        along = rng.uniform(-300, 300, n)
        points = np.stack([500 + along * math.cos(angle), 400 + along * math.sin(angle)], axis=1) + rng.normal(0, 0.8, (n, 2))
        if n > 10:
            points[: n // 4] += rng.uniform(20, 200, (n // 4, 2))
        base = rng.uniform(0.1, 3, n)
        way = np.array([math.cos(angle), math.sin(angle)])
        rows += [(k, float(x), float(y), float(w)) for (x, y), w in zip(points, base)]
        ways.append((k, *map(float, way)))
        want[k] = numpy_line(points, base, way, 4)
    rows.append((9, 1.0, 1.0, 1.0))  # a single point has no line
    got = robust.robust_lines(spark.createDataFrame(rows, "k int, x double, y double, w double"), ["k"], "x", "y", "w", spark.createDataFrame(ways, "k int, dx double, dy double"), 4)
    found = {r["k"]: [r["ax"], r["ay"], r["dx"], r["dy"], r["scale"]] for r in got.collect()}
    assert set(found) == set(want)
    for k in want:
        assert found[k] == pytest.approx(want[k], abs=1e-9, rel=1e-9)


@pytest.mark.parametrize("odd", [(0, None, 1.0, 1.0), (0, 1.0, 1.0, 0.0), (0, 1.0, float("nan"), 1.0), (0, 1.0, 1.0, float("inf"))])
def test_robust_lines_refuse(spark, odd):
    points = spark.createDataFrame([(0, 0.0, 0.0, 1.0), odd], "k int, x double, y double, w double")
    with pytest.raises(Exception, match="finite"):
        robust.robust_lines(points, ["k"], "x", "y", "w", spark.createDataFrame([(0, 1.0, 0.0)], "k int, dx double, dy double")).collect()


def test_costly_stage_stands_behind_the_limit(spark):
    rng = random.Random(2)
    rows = [(g, f"c{i}", round(rng.random(), 2)) for g in range(4) for i in range(rng.choice([1, 3, 12]))]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(s):
        seen.add(1)
        return 10 + s

    df = spark.createDataFrame(rows, "g int, id string, s double")
    out = staged.two_stage(df, ["g"], "id", "s", lambda m: 0.8 * F.col("s") + 0.2 * m, lambda t: t.withColumn("full_score", slow("pre_score")), 9)
    got = {(r["g"], r["id"]): r for r in out.collect()}
    assert seen.value == sum(min(5, n) for n in (len([r for r in rows if r[0] == g]) for g in range(4)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("BatchEvalPython") :]  # what is below comes later
    for g in range(4):
        own = [(i, s) for k, i, s in rows if k == g]
        pre = {}
        for i, s in own:
            other = max((t for j, t in own if j != i), default=0.0)
            pre[i] = 0.8 * s + 0.2 * min(1.0, max(0.0, 0.5 + (s - other) * 5))
        for n, (i, v) in enumerate(sorted(pre.items(), key=lambda p: (-p[1], p[0])), 1):
            r = got[g, i]
            assert r["pre_score"] == pytest.approx(v) and r["pre_rank"] == n
            assert (r["selected_rank"], r["reason"]) == ((n, None) if n <= 5 else (None, "topk_limit"))
            assert r["score"] == pytest.approx(10 + v if n <= 5 else v)


def every_combination(slots, width, height, objective):
    found = []
    for chosen in itertools.product(*slots):
        corners = structured.combined([o["corners"] for o in chosen])
        if corners is None:
            continue
        legal, both, moved = structured.legality(corners, [o["anchor"] for o in chosen], width, height)
        if legal:
            risks, upper, support = ([o[c] for o in chosen] for c in ("risk", "upper", "support"))
            rest = (max(upper), not both, moved, -min(support))
            lead = (max(risks), *rest, sum(risks)) if objective == "minimax" else (sum(risks), max(risks), *rest)
            found.append((*lead, tuple(o["option"] for o in chosen)))
    return min(found, default=None)


def some_slots(rng, n):
    """Options around one quad; the cheapest are turned and so give no legal quad."""
    slots = []
    for edge in range(4):
        slot = []
        for i in range(n):
            q = [(x + rng.uniform(-25, 25), y + rng.uniform(-25, 25)) for x, y in ((100, 100), (900, 100), (900, 700), (100, 700))]
            bad = rng.random() < 0.4
            q = q[1:] + q[:1] if bad else q
            slot.append({"option": f"{edge}-{i}", "edge": edge, "corners": q, "anchor": q, "risk": round(rng.random() * (0.2 if bad else 1), 1), "upper": rng.choice([0.5, 1.0]), "support": float(rng.randrange(3)), "current": i == n - 1})
        slots.append(sorted(slot, key=lambda o: (o["risk"], o["option"])))
    return slots


@pytest.mark.parametrize("objective", ["minimax", "sum"])
def test_search_equals_enumeration(objective):
    rng = random.Random(7)
    for _ in range(12):
        slots = some_slots(rng, 8)
        best = structured.best_combination(slots, 1000.0, 800.0, objective)
        want = every_combination(slots, 1000.0, 800.0, objective)
        assert (best is None) == (want is None)
        if best:
            assert tuple(o["option"] for o in best[2]) == want[-1] and best[0][0] == want[0]


def test_lines_of_a_legal_quad_give_its_corners():
    q = [(0.0, 0.0), (90.0, 5.0), (100.0, 80.0), (-5.0, 70.0)]
    assert [c for p in structured.combined([q] * 4) for c in p] == pytest.approx([c for p in q for c in p])
    assert structured.combined([[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]] * 4) is None


def frame(spark, groups):
    rows = [(g, o["edge"], o["option"], [{"x": x, "y": y} for x, y in o["corners"]], None, o["risk"], o["upper"], o["support"], o["current"]) for g, slots in groups.items() for s in slots for o in s]
    points = "array<struct<x:double,y:double>>"
    return spark.createDataFrame(rows, f"g int, edge int, option string, corners {points}, anchor {points}, risk double, upper double, support double, current boolean")


def test_proposals(spark):
    rng = random.Random(11)
    groups = {g: some_slots(rng, rng.choice([1, 4, 10])) for g in range(8)}
    bad = some_slots(rng, 3)
    for s in bad:  # the two cheapest of the first edge are turned; the current one is fine
        for k, o in enumerate(s):
            o["corners"] = o["anchor"] = [(900.0, 100.0), (900.0, 700.0), (100.0, 700.0), (100.0, 100.0)] if k < 2 and o["edge"] == 0 else [(100.0, 100.0), (900.0, 100.0), (900.0, 700.0), (100.0, 700.0)]
            o["risk"], o["current"] = float(k), k == 2
    groups[100], groups[101] = bad, some_slots(rng, 2)[:3]
    got = {r["g"]: r for r in structured.structured_proposal(frame(spark, groups), ["g"], 1000.0, 800.0, 2).collect()}
    assert 101 not in got  # an edge has no option
    assert got[100]["fallback"] and got[100]["worst"] == 2.0 and got[100]["margins"] == [1.0] * 4
    for g in range(8):
        want = every_combination([s[:2] for s in groups[g]], 1000.0, 800.0, "minimax")
        if want:
            assert tuple(got[g]["ids"]) == want[-1] and not got[g]["fallback"]
            assert got[g]["margins"] == pytest.approx([s[1]["risk"] - s[0]["risk"] if len(s) > 1 else structured.ALONE for s in groups[g]])
    with pytest.raises(ValueError):
        structured.structured_proposal(frame(spark, groups), ["g"], 1.0, 1.0, 9)


def test_clusters_read_many_images_at_once(spark):
    """Before, each image was a call of its own; images may lie across the borders of batches."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": list(k), "v": list(range(len(k)))}) for k in ("aab", "b", "b", "c", "cd", "", "d", "e")]
    tables = [t.column("k").to_pylist() for t in ranking._whole_groups(iter(batches))]
    assert tables == [list("aa"), list("bbb"), list("cc"), list("dd"), list("e")]
    many = pa.RecordBatch.from_pydict({"k": [i // 3 for i in range(300)]})
    assert [t.num_rows for t in ranking._whole_groups(iter([many]))] == [297, 3]

    quad = lambda x: [x, 0.0, x + 9, 0.0, x + 9, 9.0, x, 9.0]
    rows = [(f"i{i}", f"c{j}", quad(float(j % 3 * 50)), -float(j)) for i in range(20) for j in range(i % 8 + 1)] + [(None, "c0", quad(0.0), 0.0)]
    frame = spark.createDataFrame(rows, "image string, candidate string, corners array<double>, rank double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r[0], r[1]): r[2] for r in ranking.complete_link_clusters(frame, "image", "candidate", ["rank"], "corners", 1000.0, 0.01).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for i in range(20):
        ordered = [(f"c{j}", quad(float(j % 3 * 50))) for j in reversed(range(i % 8 + 1))]
        assert [got[f"i{i}", c] for c, _ in ordered] == ranking.complete_link([q for _, q in ordered], 1000.0, 0.01)
