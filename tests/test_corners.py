import math
import random

import pytest
from pyspark.sql import functions as F

from quartzframe.functions import corners
from quartzframe.functions import geometry as g

W, H = 640, 480


def beyond(p):
    x = -p[0] if p[0] < 0 else max(0, p[0] - (W - 1))
    y = -p[1] if p[1] < 0 else max(0, p[1] - (H - 1))
    return x / W + y / H


def held(p):
    return [int(max(0, min(p[0], W - 1))), int(max(0, min(p[1], H - 1)))]


def opposite(q, t):
    a, b, c = (q[(t + i) % 4] for i in (1, 2, 3))
    return [a[0] + c[0] - b[0], a[1] + c[1] - b[1]]


def by_hand(q, trust, least=0.6):
    q, trust = [list(p) for p in q], list(trust)
    if all(c > least for c in trust):
        return [held(p) for p in q], trust, "found"

    def infer(targets, share, cut, only_bad):
        for t in targets:
            others = [i for i in range(4) if i != t]
            if all(trust[i] > least for i in others) and not (only_bad and trust[t] > least):
                p = opposite(q, t)
                p = [int(v) for v in p] if cut else p
                far = beyond(p)
                if far <= 0.1:
                    return t, held(p), sum(trust[i] for i in others) / 3 * share * (1 - min(2 * far, 0.3) if far > 0 else 1)
        return None

    def upright():
        for i in range(4):
            a, b, c = q[i - 1], q[i], q[(i + 1) % 4]
            u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
            n = math.hypot(*u) * math.hypot(*v)
            if not n or not 60 < math.degrees(math.acos(max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / n)))) < 120:
                return False
        return True

    how = "none"
    for name, args in (("edges", ((3, 2, 0, 1), 0.95, False, False)), ("diagonal", ((3, 0, 1, 2), 0.9, True, True))):
        one = infer(*args)
        if one and one[2] > trust[one[0]]:
            q[one[0]], trust[one[0]], how = one[1], one[2], name
            if upright():
                break
        elif how == "edges":
            how = "unchecked"
    return [held(p) for p in q], trust, how


def run(spark, cases):
    rows = [(i, None if q is None else [tuple(map(float, p)) for p in q], t) for i, (q, t) in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"i int, q {g.QUAD}, t array<double>")
    found = frame.select("i", corners.completed(F.col("q"), F.col("t"), F.lit(W), F.lit(H)).alias("c")).orderBy("i").collect()
    return [r["c"] and ([list(p) for p in r["c"]["corners"]], list(r["c"]["confidences"]), r["c"]["how"]) for r in found]


def test_against_rules_by_hand(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(1500):
        q = [[x + rng.randint(-60, 60) / 2, y + rng.randint(-60, 60) / 2] for x, y in ((20, 20), (610, 20), (610, 450), (20, 450))]
        bad = rng.randrange(4)
        q[bad] = [q[bad][0] + rng.randint(-200, 200), q[bad][1] + rng.randint(-200, 200)]
        trust = [round(rng.uniform(0.55, 1), 2) for _ in range(4)]
        trust[bad] = rng.choice([0.1, 0.5, 0.6, 0.62, 0.9])
        cases.append((q, trust))
    # the parallelogram's corner is outside by a fraction more than an edge pair may be; its whole part isn't
    cases.append(([[100, 0], [500, 0], [335.5, 300], [300, 300]], [0.9, 0.9, 0.9, 0.2]))
    got, want = run(spark, cases), [by_hand(*c) for c in cases]
    assert want[-1][2] == "diagonal"
    assert {w[2] for w in want} == {"found", "edges", "diagonal", "unchecked", "none"}
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == b[2]


def test_defined_cases(spark):
    square = [[10, 10], [110, 10], [110, 110], [10, 110]]
    got = run(spark, [(None, [0.9] * 4), (square, None), (square[:3], [0.9] * 4), (square, [0.9] * 3), (square, [0.9, 0.9, 0.9, None]), ([[10, 10]] * 4, [0.9, 0.9, 0.9, 0.1])])
    assert got[:4] == [None] * 4
    assert got[4] == (square, [0.9, 0.9, 0.9, None], "none")  # a null confidence isn't good, and nothing is higher than it
    assert got[5][0] == [[10, 10]] * 4 and got[5][2] == "unchecked"


def test_overshoot_adds_shares(spark):
    point = g.point(F.lit(-64.0), F.lit(527.0))
    assert spark.range(1).select(g.overshoot(point, F.lit(W), F.lit(H))).first()[0] == pytest.approx(0.1 + 0.1)
