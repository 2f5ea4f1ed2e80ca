import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quartzframe.functions import geometry as g
from quartzframe.functions import stats
from quartzframe.operators import decisions, evaluation, ranking, sequences


def test_paired_rate(spark):
    rows = spark.createDataFrame([(True, False), (True, True), (False, True), (True, False), (None, False)], "a boolean, b boolean")
    got = evaluation.paired_rate(rows, F.col("a"), F.col("b")).first()
    assert (got["n"], got["improved"], got["worsened"], got["passed"]) == (5, 2, 1, False)
    assert got["estimate"] == pytest.approx(0.2) and got["ci_lower"] == pytest.approx(0.2 - 1.96 * (3 / 25) ** 0.5)


def test_budget_counts_and_gate(spark):
    rows = spark.createDataFrame([("fit", True, None, False), ("fit", False, 2, False), ("calibration", False, 12, False), ("calibration", False, None, True), ("calibration", False, None, False)], "s string, a boolean, r int, c boolean")
    counts = evaluation.budget_counts(rows, "a", "r", "c", "s", (1, 8, 16))
    all_ = counts.where("subset = 'all'").first()
    assert [all_[c] for c in ("samples", "base", "ranked", "other", "any", "within_1", "within_8", "within_16", "gain")] == [5, 1, 2, 1, 4, 2, 3, 4, 3]
    gate = evaluation.feasibility_gate(counts, frozen_accessed=True).first()
    assert not gate["passed"] and gate["failed"].split(",")[0] == "union_rate" and "frozen_not_accessed" in gate["failed"] and gate["needed_union"] == 5


def test_terminal_summary_counts_fallback_as_automatic(spark):
    rows = spark.createDataFrame([("automatic", True, False), ("v7_fallback", True, False), ("manual_review", False, False), ("error", False, False)], "s string, a boolean, b boolean")
    summary = evaluation.terminal_summary(rows, "s", "a", "b")
    got = summary.first()
    assert (got["automatic"], got["strict"], got["manual"], got["fallback"], got["strict_rate"]) == (2, 2, 2, 1, 0.5)
    assert evaluation.terminal_gate(summary).first()["failed"] == "strict_rate,manual_rate"
    assert evaluation.terminal_summary(rows.limit(0), "s", "a", "b").first()["strict_rate"] == 0.0


@pytest.mark.parametrize("n", [1, 4, 20, 40, 101])
def test_quantile_rules(spark, n):
    values = np.random.default_rng(n).integers(0, 50, n).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("k", F.lit(1))
    got = evaluation.p95_rules(df, ["k"], "v").first()
    assert got["nearest"] == np.sort(values)[min(n - 1, int(np.ceil(0.95 * n)) - 1)] and got["higher"] == np.quantile(values, 0.95, method="higher")
    assert evaluation.work_summary(df, "v").first()["p95"] == got["higher"]


def test_study_arms_balance_and_repeat(spark):
    rows = spark.createDataFrame([(f"i{k}", f"g{k // 2}", "x" if k < 12 else "y") for k in range(20)], "i string, g string, s string")
    a = evaluation.study_arms(rows, "i", "g", "s", 1).orderBy("i").collect()
    assert a == evaluation.study_arms(rows.orderBy(F.desc("i")), "i", "g", "s", 1).orderBy("i").collect()
    frame = pd.DataFrame([r.asDict() for r in a])
    assert (frame.groupby("g")["arm"].nunique() == 1).all() and (frame.drop_duplicates("g").groupby("stratum")["arm"].value_counts() >= 2).all()


def test_bootstrap(spark):
    rows = spark.createDataFrame([("k", 1.0, 0.0)] * 30 + [("k", 0.0, 1.0)] * 2, "k string, a double, b double")
    got = evaluation.bootstrap_delta(rows, "a", "b", "k").first()
    assert got["estimate"] == pytest.approx(28 / 32) and 0.5 < got["ci_lower"] < got["estimate"] and got["passed"]


def test_slices(spark):
    df = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 5.0}, {"x": 90.0, "y": 90.0}, {"x": 2.0, "y": 100.0}],)], f"q {g.QUAD}")
    got = df.select(evaluation.derive_slices(F.array(F.lit("glossy")), F.col("q"), F.lit(100.0), F.lit(100.0)).alias("s")).first()["s"]
    assert got == ["glossy", "perspective", "touches_border"]


def test_sequences(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0, 5.0],)], "v array<double>")
    assert df.select(sequences.local_maxima(F.col("v")).alias("m")).first()["m"] == [2]
    flags = spark.createDataFrame([([True, False, False, True, False],), ([],)], "f array<boolean>")
    assert [r["m"] for r in flags.select(sequences.longest_false_share(F.col("f")).alias("m")).collect()] == [0.4, 1.0]
    items = spark.createDataFrame([([{"p": 0.0}, {"p": 1.0}, {"p": 3.0}, {"p": 9.0}],)], "i array<struct<p:double>>")
    assert [x["p"] for x in items.select(sequences.separated(F.col("i"), "p", 2.0, 3).alias("m")).first()["m"]] == [0.0, 3.0, 9.0]


def test_round_robin_and_diversity():
    take = lambda name, item, accepted: item not in [i for _, i in accepted]
    assert ranking.round_robin({"a": [1, 2, 3], "b": [1, 9]}, 4, 2, take) == [("a", 1), ("a", 2), ("b", 9), ("a", 3)]
    items = [(0.9, "a", "s1", 0), (0.8, "b", "s1", 1), (0.7, "c", "s2", 0), (0.6, "d", "s2", 5)]
    assert [x[1] for x in ranking.diverse_order(items, 3, lambda x, y: abs(x - y) <= 0)] == ["a", "b", "d"]


def test_complete_link_is_order_dependent():
    line = [np.full(8, x) for x in (0.0, 1.0, 2.0, 10.0)]
    assert ranking.complete_link(line, 1.0, 1.5) == [0, 0, 1, 2]
    assert ranking.complete_link(line[::-1], 1.0, 1.5) == [0, 1, 1, 2]


def test_structured_choice(spark):
    rows = spark.createDataFrame([(1, s, s * 10 + o, float((o * 7 + s * 3) % 5)) for s in range(4) for o in range(3)], "k int, s int, o int, r double")
    got = ranking.structured_choice(rows, "k", "s", "o", "r").first()
    options = [[((o * 7 + s * 3) % 5, s * 10 + o) for o in range(3)] for s in range(4)]
    best = [min(x) for x in options]
    assert (got["sum"], got["ids"]) == (sum(b[0] for b in best), [b[1] for b in best])


def test_decision_order_and_nulls(spark):
    row = spark.createDataFrame([(None, True)], "a boolean, b boolean")
    made = decisions.decide([decisions.Case(F.col("a"), "x", "first"), decisions.Case(F.col("b"), "y", "second")], "z", "none")
    assert tuple(row.select(made.alias("m")).first()["m"]) == ("y", "second")


def test_learned_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "f array<double>")
    score = stats.linear_score(F.col("f"), [0.0, 1.0], [1.0, 2.0], [0.5, 2.0], -1.0)
    assert df.select(stats.logistic(score).alias("p")).first()["p"] == pytest.approx(1 / (1 + np.exp(-0.5)))


def test_unknown_states_are_refused_and_any_subset_may_be_named(spark):
    rows = spark.createDataFrame([("odd", True, False)], "s string, a boolean, b boolean")
    with pytest.raises(Exception, match="not a terminal state: odd"):
        evaluation.terminal_summary(rows, "s", "a", "b").collect()
    counts = spark.createDataFrame([("all", 10, 10, 40), ("audit", 5, 5, 1)], 'subset string, samples long, any long, gain long')
    assert evaluation.feasibility_gate(counts, subset="audit").first()["passed"]


def test_rounds_and_complete_links():
    from quartzframe.operators import ranking

    every = lambda name, item, accepted: True
    assert [i for _, i in ranking.round_robin({"a": [1, 2, 3, 4], "b": [5]}, 5, 2, every)] == [1, 5, 2, 3, 4]
    assert [i for _, i in ranking.round_robin({"a": [1, 2, 3], "b": [5, 6, 7]}, 6, 2, every)] == [1, 5, 2, 6]  # no queue is empty: quotas stay
    at = lambda x: np.full(8, float(x))
    assert ranking.complete_link([at(0), at(1), at(2), at(9), at(1.5)], 1.0, 1.6) == [0, 0, 1, 2, 1]
