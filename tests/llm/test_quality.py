import collections
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartzframe.llm import neighbours as nb
from quartzframe.llm import weak_rules as wr

DATA = "/root/testdata/sf0.01"


def brute(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, same = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            same += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), same, len(hit)


@given(st.text("ab \n\t\x0b|#é", max_size=120) | st.text(max_size=60) | st.lists(st.sampled_from("xy"), max_size=60).map(" ".join))
def test_counts(t):
    assert wr.text_counts(t)[:5] == brute(t)


def test_rules_keep_good_documents(spark, table):
    good = [(i, " ".join(f"word{(i * 31 + k * k) % 97}" for k in range(60)) + ".") for i in range(80)]
    bad = [(100 + i, " ".join(f"w{(i + k * k) % 89}###" for k in range(60))) for i in range(8)]
    rows = good + bad + [(200, None), (201, ""), (202, "same words " * 50), (203, "few words"), (None, good[0][1])]
    docs = table(*rows, extra=True)
    got = {r["doc_id"]: r for r in wr.judge(docs).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert [got[i]["base_failed"] for i in (200, 201, 202, 203)] == [True] * 4 and not got[202]["kept"]
    kept = wr.filter_documents(docs)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in good} | {None} and kept.columns == docs.columns
    assert wr.judge(table()).count() == 0


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    n, bad = 20000, np.random.default_rng(2).random(20000) < 0.2
    right = np.array([0.9, 0.85, 0.95])
    votes = np.stack([np.where((rng.random(n) < r) == ~bad, 1, -1) for r in right], axis=1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = wr.estimate(patterns, count.astype(float))[inverse.reshape(-1)] >= 0.5
    assert (good == ~bad).mean() > 0.95
    assert len(wr.estimate(np.zeros((0, 3)), np.zeros(0))) == 0


def test_rules_on_labelled_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = wr.judge(docs).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (rows["kept"] == (rows["quality"] == 1)).mean() > 0.97


def test_held_out_accuracy(spark):
    rows = nb.op7_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 90 and (rows["predicted"] == rows["quality"]).mean() > 0.96


def test_scores_are_exact_votes():
    rng = np.random.default_rng(4)
    p = nb.Neighbours(nearest=5)
    known, block, labels = nb.unit(rng.standard_normal((200, 8))), nb.unit(rng.standard_normal((30, 8))), rng.integers(0, 2, 200).astype(float)
    got = nb.vote(block, known, labels, p)
    for i, row in enumerate(block):
        near = known @ row
        top = np.argsort(-near)[:5]
        weight = np.maximum(near[top].astype(float), 0) ** p.power
        assert got[i] == pytest.approx((weight * labels[top]).sum() / weight.sum(), abs=1e-5)


def test_edge_cases_of_scores(spark, table):
    docs = table((1, None), (2, ""), (3, "good words here and there"), (3, "good words here and there"), (4, "x" * 200_000), (None, "no id"), extra=True)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (9, 1), (2, None)], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in nb.score(docs, labels).collect()}
    assert set(got) == {1, 2, 3, 4, None} and all(0 <= v <= 1 for v in got.values()) and got[1] == got[2]
    none = nb.score(docs, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert nb.score(table(), labels).count() == 0
    assert none.select(F.count("score")).first()[0] == 6
