"""Language of a text by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and each run of characters that aren't letters counts as a space; its
n-grams of 1 to 4 code points are hashed to a fixed number of features. Training counts features by
language over all rows that may be learnt from, added up by Spark; the matrix of log-probabilities, of
features times languages, is broadcast, and each text's sparse counts are multiplied with the rows they touch.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where nothing
could be learnt. Long texts are read whole, in blocks. Repeated rows, and rows of one id, are each learnt from and
predicted by their own text. Of languages that are equally likely the ASCII-least is taken. An empty
table gives an empty result. Only the named columns are read, so further columns never clash.
More than ``most_languages`` languages raise an error, as the model would have no bound.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Code points that are hashed at once.
BLOCK = 1 << 19
UNKNOWN = "und"
MIX = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class NaiveBayes:
    """features: hashed n-grams; orders: lengths of n-grams; smoothing: added to each count; most_languages: bound of the model."""

    features: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3, 4)
    smoothing: float = 0.1
    most_languages: int = 400


@functools.cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def gram_counts(text: str | None, p: NaiveBayes) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, block by block."""
    found = np.zeros(p.features, np.int64)
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank, joined = np.uint32(32), np.zeros(0, np.uint32)
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK]
        part = np.where(letters()[part], part, blank)
        # a blank behind a blank goes, across blocks too
        part = part[(part != blank) | (np.concatenate([joined[-1:] if len(joined) else [0], part[:-1]]) != blank)]
        joined = np.concatenate([joined[max(0, len(joined) - max(p.orders) + 1) :], part])
        for n in p.orders:
            tail = joined[max(0, len(joined) - len(part) - n + 1) :]  # its grams end in this block
            if len(tail) < n:
                continue
            mixed = np.full(len(tail) - n + 1, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ tail[k : len(tail) - n + 1 + k]) * MIX
                mixed ^= mixed >> np.uint32(15)
            found += np.bincount(mixed % np.uint32(p.features), minlength=p.features)
    return found


def learn(docs: DataFrame, p: NaiveBayes, text: str = "text", language: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in ASCII order and the matrix (features + 1, languages) of log-probabilities, the last row the priors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(t):
                    own = counts.setdefault(name, np.zeros(p.features + 1, np.int64))
                    own[:-1] += gram_counts(t, p)
                    own[-1] += 1
                    if len(counts) > p.most_languages:
                        raise ValueError(f"more than {p.most_languages} languages")
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["name", "feature", "n"])

    rows = docs.select(F.col(language).cast("string").alias("name"), F.col(text).cast("string").alias("text")).where("name is not null")
    totals = rows.mapInArrow(run, "name string, feature int, n long").groupBy("name", "feature").agg(F.sum("n").alias("n"))
    found = totals.toArrow()  # at most features times languages rows
    names = sorted(set(found.column("name").to_pylist()))
    if len(names) > p.most_languages:
        raise ValueError(f"more than {p.most_languages} languages")
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((p.features + 1, len(names)))
    counts[found.column("feature").to_numpy(), [place[n] for n in found.column("name").to_pylist()]] = found.column("n").to_numpy()
    grams, priors = counts[:-1] + p.smoothing, counts[-1]
    return names, np.vstack([np.log(grams / grams.sum(axis=0)), np.log(priors / max(priors.sum(), 1))])


def posterior(text: str, model: np.ndarray, p: NaiveBayes) -> np.ndarray:
    """Probability of each language."""
    counts = gram_counts(text, p)
    at = np.flatnonzero(counts)
    total = counts[at] @ model[at] + model[-1]
    likely = np.exp(total - total.max())
    return likely / likely.sum()


def predict(docs: DataFrame, names: list[str], model: np.ndarray, p: NaiveBayes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features times languages, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for t in batch.column(1).to_pylist():
                if names and has_letter(t):
                    chance = posterior(t, shared.value, p)
                    best = int(chance.argmax())
                    found.append(names[best])
                    scores.append(float(chance[best]))
                else:
                    found.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, docs = NaiveBayes(), documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    names, model = learn(docs.where(~held_out), p)
    return predict(docs, names, model, p).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
