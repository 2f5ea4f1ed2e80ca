"""Feature vectors against plain Python on random pools, and the cases that a pool, a mask or a proposal may hold."""

import itertools
import math
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quartzframe.functions.stats import clamped_number
from quartzframe.operators import features as ft

SCHEMA = (
    "image string, source string, candidate string, corners array<struct<x:double,y:double>>, width int, height int, "
    + ", ".join(f"{n} double" for n in ft.NUMBERS)
    + ", "
    + ", ".join(f"{n} array<double>" for n in ft.PER_SIDE)
)


def candidate(r, image, source, name, corners=None):
    corners = corners or [(x + r.randint(-9, 9), y + r.randint(-9, 9)) for x, y in ((100, 80), (500, 80), (500, 400), (100, 400))]
    corners = [(float(x), float(y)) for x, y in corners]
    numbers = [r.choice([None, float("inf"), float("nan"), 50.0, -3.0, r.random()]) for _ in ft.NUMBERS]
    sides = [r.choice([None, [1.0], [0.1, 0.2, None, 30.0]]) for _ in ft.PER_SIDE]
    return (image, source, name, corners, 640, 480, *numbers, *sides)


def plain(rows):
    """The same by loops over all pairs."""

    def number(v):
        return 0.0 if v is None or not math.isfinite(v) else max(-20.0, min(20.0, v))

    def gap(a, b, i):
        def away(p, s, e):
            dx, dy = e[0] - s[0], e[1] - s[1]
            return abs(dx * (s[1] - p[1]) - (s[0] - p[0]) * dy) / math.hypot(dx, dy)

        (p, q), (s, e) = (a[i], a[(i + 1) % 4]), (b[i], b[(i + 1) % 4])
        return max(away(p, s, e), away(q, s, e), away(s, p, q), away(e, p, q)) / math.hypot(640, 480)

    out = {}
    for image, pool in itertools.groupby(sorted(rows, key=lambda r: str(r[0])), key=lambda r: r[0]):
        pool = list(pool)
        for row, i in itertools.product(pool, range(4)):
            same = sorted((r for r in pool if r[1] == row[1]), key=lambda r: (-number(r[6]), r[2]))
            least = [min((gap(row[3], r[3], i) for r in pool if r[1] == s and r[1:3] != row[1:3]), default=None) for s in ft.SOURCES]
            n = dict(zip(ft.NUMBERS, map(number, row[6:14]), strict=True))
            vector = [n["score"], math.copysign(math.log1p(abs(n["raw_prior"])), n["raw_prior"]), n["prior"], n["area_ratio"], n["exterior"], n["valid_sides"] / 4, math.log1p(max(0, n["seed_support"])), n["seed_groups"] / 4]
            vector += [number(v[i]) if v and len(v) == 4 else 0.0 for v in row[14:]] + [float(row[1] == s) for s in ft.SOURCES]
            vector += [same.index(row) / max(1, len(same) - 1)] + [(0.1 if x is None else x) / 0.1 for x in least]
            vector += [sum(x is not None and x <= limit and s != row[1] for s, x in zip(ft.SOURCES, least, strict=True)) / 4 for limit in ft.AGREE]
            out[image, row[1], row[2], ("top", "right", "bottom", "left")[i]] = vector
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_pool_vectors_equal_loops_over_pairs(spark, block):
    r = random.Random(4)
    rows = [candidate(r, image, r.choice(ft.SOURCES), f"c{i:02d}") for image, n in (("a", 40), (None, 6), ("one", 1)) for i in range(n)]
    rows += [candidate(r, "a", s, f"x{i}", rows[0][3]) for i, s in enumerate((rows[0][1], *ft.SOURCES))]
    got = ft.pool_vectors(spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA), ["image"], block=block).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for g in got:
        assert g["features"] == pytest.approx(want[g["image"], g["source"], g["candidate"], g["edge"]], abs=1e-12)


def test_numbers_that_are_missing_take_the_default(spark):
    values = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),), (-30.0,), (30.0,), (0.5,)], "v double")
    assert [r[0] for r in values.select(clamped_number(F.col("v"), 0.25)).collect()] == [0.25, 0.25, 0.25, -20.0, 20.0, 0.5]


def test_an_edge_without_length_is_at_no_distance(spark):
    r = random.Random(2)
    rows = [candidate(r, "a", "edge", "c1", [(5, 5)] * 4), candidate(r, "a", "mask", "c2")]
    got = {(x["candidate"], x["edge"]): x["features"][18:] for x in ft.pool_vectors(spark.createDataFrame(rows, SCHEMA), ["image"]).collect()}
    assert len(got) == 8 and all(v == [1.0] * 4 + [0.0] * 3 for v in got.values())


def test_unknown_source_and_empty_pool(spark):
    r = random.Random(1)
    assert ft.pool_vectors(spark.createDataFrame([], SCHEMA), ["image"]).count() == 0
    for source in ("other", None):
        # where two stages fail at once, Spark reports both in one error of its own
        with pytest.raises((PySparkException, Py4JJavaError), match="unsupported source"):
            ft.pool_vectors(spark.createDataFrame([candidate(r, "a", source, "c")], SCHEMA), ["image"]).collect()


def test_fields_of_truth_are_refused_at_any_depth(spark):
    rows = spark.range(1).select(F.struct(F.array(F.struct(F.lit(1).alias("V7_Strict"))).alias("x")).alias("a"), F.create_map(F.lit("k"), F.struct(F.lit(1).alias("photo_truth"))).alias("m"), F.lit(1).alias("truthful"))
    assert ft.leaks(rows.schema) == ["a.x[].V7_Strict", "m{}.photo_truth"]
    with pytest.raises(ValueError, match="V7_Strict"):
        ft.without_leaks(rows)
    maps = spark.sql("select map('score', 1.0, 'mean_normalized_corner_error', 2.0) as m")
    with pytest.raises(PySparkException, match="mean_normalized_corner_error"):
        ft.without_leaks(maps, "m").collect()
    assert ft.without_leaks(spark.sql("select map('score', 1.0) as m"), "m").collect()[0]["m"].keys() == {"score"}


def evidence(spark, **changed):
    profile = dict.fromkeys(ft.PROFILE, 0.25)
    refinement = dict.fromkeys((n if n != "orientation_change" else "orientation_change_degrees" for n in ft.REFINEMENT[:-1]), 3.0) | {"accepted": True}
    for name, value in changed.items():
        (profile if name in profile else refinement)[name] = value
    struct = lambda d: F.struct(*[F.lit(v).alias(n) for n, v in d.items()])
    return spark.range(1).select(ft.evidence_vector(F.array(*[F.lit(0.5)] * 25), F.lit("right"), struct(profile), struct(refinement), F.lit(True)).alias("features"), F.lit("o").alias("option"))


def test_evidence_is_in_order_and_masked_by_mode(spark):
    rows = evidence(spark)
    [v] = [r["features"] for r in rows.collect()]
    assert len(v) == len(ft.NAMES) == 51
    assert v == [0.5] * 25 + [0, 1, 0, 0] + [0.25] * 9 + [3.0] * 4 + [0.1, 3.0, 1.0, 1.0] + [0.0] * 5
    for mode, n in (("metadata", 29), ("profile", 38), ("full", 51)):
        [m] = [r["vector"] for r in ft.option_vectors(rows, ["option"], mode).collect()]
        assert m == v[:n] + [0.0] * (51 - n)
    for bad in (None, float("nan"), float("-inf")):
        with pytest.raises(PySparkException, match="must be finite: profile_entropy"):
            evidence(spark, entropy=F.lit(bad).cast("double")).collect()
    with pytest.raises(ValueError):
        ft.masked(F.col("features"), "some")
    for short in (F.array(F.lit(1.0)), F.lit(None).cast("array<double>"), F.array(*[F.lit(None).cast("double")] * 51)):
        with pytest.raises(PySparkException, match="invalid"):
            spark.range(1).select(ft.masked(short, "full")).collect()


def test_masks_follow_the_peak_mode_and_their_ranges(spark):
    rows = evidence(spark)
    mask = lambda peak, rest=0.5: spark.range(1).select(F.lit("o").alias("option"), F.struct(F.lit(peak).alias(ft.MASK[0]), *[F.lit(rest).alias(n) for n in ft.MASK[1:]]).alias("mask"))
    for how, offsets in (("signed", [-0.04]), ("absolute", [0.04]), ("signed_absolute", [-0.04, 0.04])):
        [v] = [r["vector"] for r in ft.option_vectors(rows, ["option"], "full", mask(-0.04), how).collect()]
        assert v[51:] == offsets + [0.5] * 7
    for bad in (mask(0.041), mask(0.0, 1.01), mask(0.0, -0.1)):
        with pytest.raises(PySparkException, match="out of its ranges"):
            ft.option_vectors(rows, ["option"], "full", bad).collect()
    with pytest.raises(PySparkException, match="mask witness option is missing"):
        ft.option_vectors(rows, ["option"], "full", mask(0.0).where("false")).collect()


def proposal(spark, risks="array(1D, 2D, 3D, 6D)"):
    same = lambda names, v: f"array_repeat(named_struct({', '.join(f'{n!r}, {v}' for n in names)}), 4)"
    profile = same(("entropy", "second_peak_ratio", "maximum_gap_ratio", "valid_coverage", "support_q10", "peak_offset"), "-0.5D")
    refined = "transform(array(true, false, false, true), x -> named_struct('accepted', x, 'residual_q95', 0.1D, 'inlier_ratio', 0.9D, 'orientation_change_degrees', 15D, 'parent_shift', 0.2D))"
    views = same(("maximum_endpoint_deviation", "view_agreement_ratio", "view_failure_ratio"), "0.125D")
    q = lambda d: "array(" + ", ".join(f"named_struct('x', {x + d}D, 'y', {y}D)" for x, y in ((0, 0), (300, 0), (300, 400), (0, 400))) + ")"
    return spark.sql(
        f"select 1 as id, {risks} as edge_risks, array(1D, 1D, 4D, 1D) as upper_corner_risks, array(0D, 0D, 0D, 2D) as edge_margins, array(1, 2, 3, 4) as cross_source_support, {profile} as profiles, {refined} as refinements, {views} as adaptive, {views} as all_views,"
        f" {q(0)} as current, {q(5)} as proposed, 300 as width, 400 as height, 2 as refined_edges, cast(null as boolean) as legal_min_parent, true as legal_both_parent, cast(null as double) as parent_displacement, 'v7_fallback' as status, cast(null as string) as reason"
    )


def test_relative_features(spark):
    made = ft.relative_features(proposal(spark), ["id"])
    [got] = [r.asDict() for r in made.collect()]
    assert len(got) == 47
    want = {
        "proposal_edge_risk_min": 1, "proposal_edge_risk_mean": 3, "proposal_edge_risk_max": 6, "proposal_edge_risk_spread": 5, "proposal_upper_risk_max": 4, "proposal_edge_margin_mean": 0.5, "proposal_cross_source_support_mean": 2.5,
        "profile_absolute_peak_offset_max": 0.5, "profile_support_q10_min": -0.5, "refinement_acceptance_ratio": 0.5, "refined_edge_ratio": 0.5, "refinement_orientation_change_max": 0.5, "geometry_legal_min_parent_anchor": 0,
        "geometry_legal_both_parent_anchor": 1, "geometry_max_min_parent_displacement": 1, "current_proposal_corner_distance_mean": 0.01, "current_proposal_corner_distance_max": 0.01, "all_view_consistency_failure_mean": 0.125,
        "status_automatic": 1, "status_manual_review": 0, "reason_edge_base": 0, "reason_other": 1,
    }
    assert {n: got[n] for n in want} == pytest.approx(want)


@pytest.mark.parametrize("risks", ["array(1D, 2D, 3D)", "array(1D, 2D, 3D, null)", "cast(null as array<double>)", "array(1D, 2D, 3D, double('nan'))"])
def test_incomplete_proposals_raise(spark, risks):
    with pytest.raises(PySparkException, match="must be finite: proposal_edge_risk"):
        ft.relative_features(proposal(spark, risks), ["id"]).collect()
