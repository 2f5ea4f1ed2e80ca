"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's byte pairs and hashed byte triples are counted over its whole length, with a mark for how
unevenly the pairs are used; all are weighted by inverse document frequency over the whole corpus, and projected to the leading singular
vectors of a bounded sample of labelled documents. The sample's vectors are broadcast; every
document's exact cosine with all of them is computed in blocks, and the labels of its nearest
neighbours vote with weights that grow with similarity.

Defined cases: a null or empty text has the zero vector and gets the sample's mean label.
Repeated rows are scored alike. Labels that are null don't count; without labelled rows every
score is 1/2. An empty table gives an empty result. Only the named columns are read, so further
columns never clash; where labels repeat a document, the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BLOCK = 256
#: Marks for the evenness of a text: -log2 of the chance that two of its byte pairs agree, in steps.
SHAPES, SHAPE_STEP = 24, 0.5
#: Pairs of pairs that a short text is filled up with, and the chance that such agree.
SHORT, USUAL = 10_000, 0.008


@dataclass(frozen=True)
class Neighbours:
    """features: size of the hashed count vector; ranks: latent dimensions; sample: most labelled documents to fit and
    vote with; nearest: neighbours that vote; power: of the similarity in a vote's weight; seed: of the projection's random start."""

    features: int = 4096
    ranks: int = 48
    sample: int = 3000
    nearest: int = 25
    power: int = 4
    seed: int = 7


def text_vectors(texts: list[str | None], size: int) -> np.ndarray:
    """Square roots of the counts of hashed byte pairs and triples, and a mark for evenness; a row for each text."""
    half = np.uint32((size - SHAPES) // 2)
    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(raw) < 2:
            continue
        pairs = (raw[:-1] << np.uint32(8)) | raw[1:]
        triples = (pairs[:-1] << np.uint32(8)) | raw[2:]
        out[i, :half] = counts = np.bincount((pairs * np.uint32(2654435761) >> np.uint32(8)) % half, minlength=half)
        out[i, half : 2 * half] = np.bincount((triples * np.uint32(2654435761) >> np.uint32(8)) % half, minlength=half)
        n = len(pairs)
        even = -np.log2((float(np.dot(counts, counts - 1)) + SHORT * USUAL) / (n * (n - 1) + SHORT))
        out[i, size - SHAPES + min(SHAPES - 1, int(even / SHAPE_STEP))] = n
    return np.sqrt(out)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def frequencies(docs: DataFrame, p: Neighbours, key: str = "doc_id", text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each feature occurs: one vector from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(p.features, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = text_vectors(batch.column(1).slice(at, BLOCK).to_pylist(), p.features)
                found += (block > 0).sum(axis=0)
                n += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.features + 1)), pa.array(np.append(found, n))], names=["feature", "n"])

    rows = _texts(docs, key, text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    every = np.zeros(p.features + 1, np.int64)
    for r in rows:  # a row for each feature
        every[r["feature"]] = r["n"]
    return int(every[-1]), every[:-1]


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Neighbours, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of at most ``p.sample`` labelled documents, those of least hash; labels (doc_id, label)."""
    known = labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)  # bounded, so it is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = text_vectors(batch.column("text").to_pylist(), p.features).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label").cast(pa.float64()), pa.array([v.tobytes() for v in block], pa.binary())], names=["doc_id", "label", "vector"])

    one = _texts(docs, key, text).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # a row an id
    found = one.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label double, vector binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    vectors = np.array([np.frombuffer(r["vector"], np.float32) for r in found]).reshape(len(found), p.features)
    return vectors, np.array([r["label"] for r in found])


def latent(vectors: np.ndarray, idf: np.ndarray, p: Neighbours) -> np.ndarray:
    """Projection (features, ranks): right singular vectors of the weighted unit rows, by a seeded randomized range finder."""
    rows = unit(vectors * idf)
    rng = np.random.default_rng(p.seed)
    base = rows.T @ (rows @ rng.standard_normal((p.features, min(p.features, p.ranks + 16))).astype(np.float32))
    for _ in range(3):
        base, _ = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(base)[0]))
    _, _, right = np.linalg.svd(rows @ base, full_matrices=False)
    return (base @ right[: p.ranks].T).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(length > 0, length, 1)).astype(np.float32)


def vote(block: np.ndarray, known: np.ndarray, labels: np.ndarray, p: Neighbours) -> np.ndarray:
    """Scores of the unit rows ``block`` by their nearest among ``known``, all that are as near as the last of them included; zero rows get the mean label."""
    mean = float(labels.mean()) if len(labels) else 0.5
    if not len(labels):
        return np.full(len(block), mean)
    near = block @ known.T
    k = min(p.nearest, len(labels))
    last = np.partition(near, len(labels) - k, axis=1)[:, len(labels) - k]
    rows, top = np.nonzero((near >= last[:, None]) & (near > 0))
    weight = near[rows, top].astype(np.float64) ** p.power
    total = np.bincount(rows, weight, len(block))
    score = np.bincount(rows, weight * labels[top], len(block)) / np.where(total > 0, total, 1)
    return np.clip(np.where(total > 0, score, mean), 0, 1)


def score(docs: DataFrame, labels: DataFrame, p: Neighbours | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score) for every document; ``labels`` (doc_id, label 0 or 1) are what may be learnt from."""
    p = p or Neighbours()
    count, df = frequencies(docs, p, key, text)
    idf = np.log((1 + count) / (1 + df)).astype(np.float32)
    vectors, marks = labelled_sample(docs, labels, p, key, text)
    base = latent(vectors, idf, p) if len(vectors) else np.zeros((p.features, 1), np.float32)
    # a projection and a sample of fixed size
    model = docs.sparkSession.sparkContext.broadcast(((idf[:, None] * base).astype(np.float32), unit((vectors * idf) @ base), marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, known, values = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                block = unit(text_vectors(part.column(1).to_pylist(), p.features) @ turn)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vote(block, known, values, p), pa.float64())], names=["doc_id", "score"])

    return _texts(docs, key, text).mapInArrow(run, "doc_id long, score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scores = score(documents(spark, sf_dir), labels)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
