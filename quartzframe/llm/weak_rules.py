"""Quality rules as weak supervision.

Each rule looks at counts of a whole text and votes good or bad, or abstains. Expectation-
maximisation over how often each combination of votes occurs estimates, for good and for bad
documents, how likely each rule's votes are; a document is kept when the posterior probability
of good is at least one half and no base rule rejects it.

Defined cases: a null or empty text has no words and fails the base rules. Repeated rows, and rows of one id, are
each judged by their own text. An empty table gives an empty result. Texts are read whole. Only the named
columns are read by ``counts``; ``filter_documents`` keeps the columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, text_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SPAN = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words", "n_upper")


def repeated_words(words: list[bytes], span: int = SPAN) -> tuple[int, int]:
    """Words in windows of ``span`` words found twice or more, and the number of different words."""
    n, rank = len(words), dict.fromkeys(words)
    unique = len(rank)
    if n <= span or unique == n:
        return 0, unique
    for i, w in enumerate(rank):
        rank[w] = i
    code = np.fromiter(map(rank.__getitem__, words), np.int64, n)
    step, most = 1, unique
    while step < span:  # ranks of runs of 2, 4 and 8 words
        code = code[:-step] * most + code[step:]
        _, code, count = np.unique(code, return_inverse=True, return_counts=True)
        again = count[code] > 1
        if not again.any():
            return 0, unique
        most, step = len(count), step * 2
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.subtract.at(edge, at + span, 1)
    return int((np.cumsum(edge[:n]) > 0).sum()), unique


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at space and \x09 to \x0D only
    repeats, unique = repeated_words(words)
    seen: set[str] = set()
    lines = same = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            same += line in seen
            seen.add(line)
    upper = 0 if text.islower() else len(text) - sum(map(text.count, BLANKS)) if text.isupper() else _upper(text)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), same, repeats, lines, unique, upper


def _upper(text: str) -> int:
    """Characters that lower-casing changes."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = text.lower()
    if len(low) != len(text):
        return sum(c.isupper() for c in text)
    return int((raw != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, and the columns COUNTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(t.as_py()) for t in batch.column(1)]
            columns = np.array(found, np.int64).reshape(len(found), len(COUNTS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=[key, *COUNTS])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, ", ".join([f"{key} long", *(f"{c} long" for c in COUNTS)]))


@dataclass(frozen=True)
class VotingRule:
    """A rate of two counts: good up to ``good``, bad beyond ``bad`` (or the reverse), no vote in between or under ``least`` units."""

    name: str
    over: str
    under: str
    good: float
    bad: float
    least: int = 1

    def vote(self) -> Column:
        rate = F.col(self.over) / F.col(self.under)
        low = self.good <= self.bad
        good, bad = (rate <= self.good, rate > self.bad) if low else (rate >= self.good, rate < self.bad)
        return F.when(F.coalesce(F.col(self.under), F.lit(0)) < self.least, 0).when(good, 1).when(bad, -1).otherwise(0)


RULES = (
    VotingRule("symbols", "n_symbols", "n_words", 0.02, 0.15),
    VotingRule("dup_lines", "n_dup_lines", "n_lines", 0.2, 0.4, 3),
    VotingRule("repeats", "n_repeat_words", "n_words", 0.05, 0.2, 20),
    VotingRule("variety", "n_unique_words", "n_words", 0.35, 0.2, 40),
    VotingRule("upper", "n_upper", "word_chars", 0.15, 0.5, 20),
    VotingRule("long_words", "word_chars", "n_words", 9.0, 14.0),
)


@dataclass(frozen=True)
class Fit:
    """rounds of EM, first belief that a bad vote is right, pseudo-counts (as a share of all documents) that keep estimates off 0 and 1."""

    rounds: int = 50
    belief: float = 0.9
    smooth: float = 1e-4


def estimate(patterns: np.ndarray, weights: np.ndarray, fit: Fit = Fit()) -> np.ndarray:
    """Posterior of good for each row of votes (-1, 0, 1), each occurring ``weights`` times.

    Votes are independent given the class, and whether a rule abstains says nothing about it. The
    first belief is that a document with a bad vote is bad. Each round keeps a bad vote at least as
    likely for bad documents as for good ones, so the classes can't change places.
    """
    if not len(patterns):
        return np.zeros(0)
    total = weights.sum()
    bad = np.where((patterns == -1).any(axis=1), fit.belief, 1 - fit.belief)
    votes = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)
    pad = fit.smooth * total
    for _ in range(fit.rounds):
        share = np.stack([weights * bad, weights * (1 - bad)])
        prior = (share.sum(axis=1) + pad) / (total + 2 * pad)
        likely = np.einsum("cp,prv->crv", share, votes) + pad
        likely /= likely.sum(axis=2, keepdims=True)
        gain = np.log(likely[0] / likely[1])
        gain[:, 0] = np.maximum(gain[:, 0], 0)
        gain[:, 1] = np.minimum(gain[:, 1], 0)
        score = np.log(prior[0] / prior[1]) + np.einsum("prv,rv->p", votes, gain)
        bad = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
    return 1 - bad


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _code(rules: tuple[VotingRule, ...]) -> Column:
    """The combination of a row's votes as a number."""
    return sum((r.vote() + 1) * 3**i for i, r in enumerate(rules)).cast("int")


def beliefs(rows: DataFrame, rules: tuple[VotingRule, ...] = RULES, fit: Fit = Fit()) -> DataFrame:
    """Rows (_code, posterior), fitted on all of ``rows`` (_code, base_failed) that pass the base rules. The driver
    gets one row for each combination of votes, 3 ** rules at most, whatever the number of documents."""
    known = rows.where("not base_failed").groupBy("_code").agg(F.count(F.lit(1)).alias("n")).orderBy("_code").collect()
    patterns = np.array([[x["_code"] // 3**i % 3 - 1 for i in range(len(rules))] for x in known]).reshape(len(known), len(rules))
    posterior = estimate(patterns, np.array([x["n"] for x in known], float), fit)
    return rows.sparkSession.createDataFrame([(x["_code"], float(p)) for x, p in zip(known, posterior)], "_code int, posterior double")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[VotingRule, ...] = RULES, fit: Fit = Fit()) -> DataFrame:
    """Rows (key, counts, base_failed, posterior, kept).

    The rules' accuracies are fitted on all documents that pass the base rules; the others have no
    posterior of their own combination unless a passing document shares it.
    """
    rows = materialize(counts(docs, key, text), "counts").withColumn("_code", _code(rules)).withColumn("base_failed", base_failed())
    judged = rows.join(F.broadcast(beliefs(rows, rules, fit)), "_code", "left").drop("_code")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= 0.5))


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[VotingRule, ...] = RULES, fit: Fit = Fit()) -> DataFrame:
    """``docs`` without the rows that are rejected. Each row is judged by its own text, whatever its id, and stays where it
    is: texts are counted once for the fit and once for the verdict rather than shuffled."""
    text_batches(docs.sparkSession)
    kinds = [(c, pa.int64()) for c in COUNTS]

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pa.Array) -> pa.Array:
        found = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(len(texts), len(COUNTS)).T
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found], fields=[pa.field(*k) for k in kinds])

    def coded(rows: DataFrame) -> DataFrame:
        inner = rows.select("_row", counted(F.col("_row." + text).cast("string")).alias("_c")).select("_row", "_c.*")
        return inner.select("_row", _code(rules).alias("_code"), base_failed().alias("base_failed"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # all columns in one, so that no name clashes
    known = beliefs(coded(docs.select(F.struct(text).alias("_row"))), rules, fit).where("posterior >= 0.5").select("_code")
    return coded(rows).where("not base_failed").join(F.broadcast(known), "_code").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept", "posterior")
