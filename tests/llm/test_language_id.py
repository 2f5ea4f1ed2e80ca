import collections
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzframe.llm import language_id as li

DATA = "/root/testdata/sf0.01"
SMALL = li.NaiveBayes(features=256)


def plain_hash(gram, p):
    h = len(gram)
    for c in gram:
        h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
        h ^= h >> 15
    return h % p.features


def plain_counts(text, p):
    """Grams of the text with each run of other characters as one blank, position by position."""
    codes = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    codes = [c for i, c in enumerate(codes) if not (i and c == codes[i - 1] == 32)]
    found = collections.Counter()
    for i in range(len(codes)):
        for n in p.orders:
            if i + n <= len(codes):
                found[plain_hash(codes[i : i + n], p)] += 1
    return found


@settings(deadline=None)
@given(st.text(max_size=80) | st.text("ab 1é", max_size=80))
def test_counts_are_those_of_a_plain_loop(text):
    got = li.gram_counts(text, SMALL)
    assert {i: n for i, n in enumerate(got.tolist()) if n} == dict(plain_counts(text, SMALL))


def test_blocks_join(monkeypatch):
    text = "Ein langer Text, über 123 Zeilen. " * 20
    whole = li.gram_counts(text, SMALL)
    for size in (1, 2, 7):
        monkeypatch.setattr(li, "BLOCK", size)
        assert (li.gram_counts(text, SMALL) == whole).all()


def test_model_against_naive_bayes_by_hand(spark):
    rows = [("en", "the cat and the dog"), ("en", "a house"), ("de", "der Hund und die Katze"), (None, "le chat"), ("de", None), ("de", "123")]
    names, model = li.learn(spark.createDataFrame(rows, "lang string, text string"), SMALL)
    assert names == ["de", "en"]
    for j, name in enumerate(names):
        counts = sum((plain_counts(t, SMALL) for n, t in rows if n == name and li.has_letter(t)), collections.Counter())
        total = sum(counts.values()) + SMALL.smoothing * SMALL.features
        assert model[:-1, j] == pytest.approx([math.log((counts[i] + SMALL.smoothing) / total) for i in range(SMALL.features)])
    assert np.exp(model[-1]) == pytest.approx([1 / 3, 2 / 3])
    text = "die Katze"
    logs = [sum(n * model[i, j] for i, n in plain_counts(text, SMALL).items()) + model[-1, j] for j in range(2)]
    assert li.posterior(text, model, SMALL)[0] == pytest.approx(1 / (1 + math.exp(logs[1] - logs[0])))


def test_edge_cases(spark, table):
    docs = table((1, None), (2, ""), (3, "12 + 3!"), (4, "the house"), (4, "the house"), (5, "das Haus " * 100_000), (None, "the"), extra=True)
    learnt = spark.createDataFrame([("en", "the house of the rising sun"), ("de", "das Haus und der Garten")], "lang string, text string")
    got = li.predict(docs, *li.learn(learnt, SMALL), SMALL).collect()
    found = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == 7 and found == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (None, "en")}
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = li.predict(docs, *li.learn(learnt.limit(0), SMALL), SMALL)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert li.predict(table(), *li.learn(learnt, SMALL), SMALL).count() == 0


def test_equal_chances_take_the_least_name(spark, table):
    learnt = spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string")
    assert li.predict(table((1, "words")), *li.learn(learnt, SMALL), SMALL).first()["lang_pred"] == "a"


def test_languages_are_bounded(spark):
    many = spark.createDataFrame([(f"l{i}", "text") for i in range(5)], "lang string, text string")
    with pytest.raises(Exception, match="more than 3 languages"):
        li.learn(many, li.NaiveBayes(features=64, most_languages=3))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = li.op13_language_id(spark, DATA).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(rows) == docs.count() and len(held) > 150
    known = held[held["lang_pred"] != "und"]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.97
