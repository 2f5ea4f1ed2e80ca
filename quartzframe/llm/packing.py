"""Retrieval packing: lexically near documents share a window.

Documents are dealt to shards by content: they are ordered by the token ids that weigh most in them, and the order is
cut at even numbers of ids, so that documents about the same things meet at any size of the corpus; a group that
is larger than a shard is divided by the next id of weight and at last by a hash. In a shard an inverted
index over token ids answers BM25 queries (document frequencies and mean length are those of the
whole corpus): starting from a seed, the window is filled with the unused documents that score
best against it; a document that doesn't fit is cut and its rest begins the next window, so every
sequence but a shard's last is full. That last one, if short, is cut into lengths that are powers
of two down to ``least_piece``, which need no padding.

Defined cases: a null or empty text has only the end id. Repeated rows are packed as documents
of their own; rows with a null id too. A document longer than a window runs over several.
An empty table gives an empty result. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize



@dataclass(frozen=True)
class Packing:
    """window: ids of a sequence; shard_tokens: ids of a shard, about; k1, b: BM25's; least_piece: least length that the last sequence is cut to."""

    window: int = 2048
    shard_tokens: int = 1 << 20
    k1: float = 1.2
    b: float = 0.75
    least_piece: int = 64


def encode(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n, ids), ids of 2 bytes each where the vocabulary allows, else 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordbpe import word_bpe

        bpe = word_bpe(tokenizer)
        kind = "<u2" if max(bpe.size, end + 1) <= 65536 else "<u4"
        for batch in batches:
            for at, plain, borders in bpe.parts(batch.column(1)):
                raw = np.insert(plain, borders[1:], end).astype(kind)
                bounds = borders + np.arange(len(borders))
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * raw.itemsize), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bounds) - 1), pa.array(np.diff(bounds)), ids.cast(pa.binary())], names=["doc_id", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary")


def _kind(n: int, ids: bytes) -> str:
    return "<u2" if len(ids) == 2 * n else "<u4"


#: Token ids that are counted at once.
COUNT_IDS = 1 << 21


def counted(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document and different id of it, sorted by both: place of the document, id, occurrences. Each document is sorted by itself,
    ids of 2 bytes in linear time."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    both = np.concatenate([np.zeros(0, np.uint16), *(np.sort(x, kind="stable") for x in ids)])
    new = np.append(True, both[1:] != both[:-1])[: len(both)]
    stops = np.cumsum(sizes)
    new[(stops - sizes)[sizes > 0]] = True
    first = np.flatnonzero(new)
    return np.repeat(np.arange(len(ids)), sizes)[first], both[first].astype(np.int64), np.diff(np.append(first, len(both)))


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a batch's documents: how many, and for each document and different id of it, sorted by both: place in the run, id, occurrences."""
    sizes = batch.column("n").to_numpy().astype(np.int64)
    groups = (np.cumsum(sizes) - sizes) // COUNT_IDS
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
    raws = batch.column("ids")
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield b - a, *counted([np.frombuffer(r, _kind(n, r)) for n, r in zip(sizes[a:b].tolist(), raws.slice(a, b - a).to_pylist())])


def frequencies(rows: DataFrame) -> DataFrame:
    """Rows (term, df): in how many documents each id occurs. There are no more rows than ids in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, terms, _ in _terms(batch):
                met = np.bincount(terms, minlength=len(df))
                met[: len(df)] += df
                df = met
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(df[met], pa.int64())], names=["term", "df"])

    return rows.select("n", "ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


#: Token ids that place a document, and bins for each shard that a group fills.
KEYS, BINS = 3, 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)


def leading(count: int, owner: np.ndarray, terms: np.ndarray, occurrences: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The KEYS ids of most weight in each of ``count`` documents, -1 where one has fewer; of equal weights the lower id first."""
    gain = occurrences * idf[terms]
    out = np.full((count, KEYS), -1, np.int64)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        docs, sizes = owner[starts], np.diff(np.append(starts, len(owner)))
        for k in range(KEYS):
            best = np.maximum.reduceat(gain, starts)
            at = np.flatnonzero(gain == np.repeat(best, sizes))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])]  # the first of each document
            some = best > -np.inf
            out[docs[some], k] = terms[at[some]]
            gain[at] = -np.inf
    return out


class Dealing:
    """A tree of bins over the order by content; those of more ids than a shard are divided by their documents' next key.
    There are at most KEYS * BINS bins for each shard."""

    def __init__(self, total: int, size: int):
        self.size, self.edge = size, [0]
        self.base, self.total, self.child, self.bins = (np.array([x], np.int64) for x in (0, total, 0, 0))

    def divide(self) -> bool:
        """Gives bins to the large nodes of the last level; whether there were any."""
        large = np.flatnonzero(self.total > self.size)
        large = large[large >= self.edge[-1]]
        if len(large):
            self.bins[large] = np.minimum(BINS * -(-self.total[large] // self.size), 1 << 16)
            self.child[large] = len(self.base) + np.cumsum(self.bins[large]) - self.bins[large]
            self.edge.append(len(self.base))
        return len(large) > 0

    def fill(self, tokens: np.ndarray) -> None:
        """``tokens``: ids in each of the new bins."""
        before = np.cumsum(tokens) - tokens
        parents = np.flatnonzero(self.child >= self.edge[-1])
        count = self.bins[parents]
        start = np.repeat(self.base[parents] - before[self.child[parents] - self.edge[-1]], count)
        none = np.zeros(len(tokens), np.int64)
        self.base, self.total = np.concatenate([self.base, start + before]), np.concatenate([self.total, tokens])
        self.child, self.bins = np.concatenate([self.child, none]), np.concatenate([self.bins, none])

    def node(self, keys: np.ndarray) -> np.ndarray:
        at = np.zeros(len(keys), np.int64)
        for level in range(KEYS):
            bins = np.where(at < len(self.bins), self.bins[np.minimum(at, len(self.bins) - 1)], 0)  # new bins aren't divided yet
            at = np.where(bins > 0, self.child[np.minimum(at, len(self.bins) - 1)] + mixed(keys[:, level]).astype(np.int64) % np.maximum(bins, 1), at)
        return at

    def shard(self, keys: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """``spread``: a hash of the document and its row, for what no key divides."""
        at = self.node(keys)
        part = (spread.view(np.uint64) >> np.uint64(11)) / 2.0**53
        return (self.base[at] + np.where(self.total[at] > self.size, part * self.total[at], 0).astype(np.int64)) // self.size


def _keys(batch: pa.RecordBatch, idf: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((0, KEYS), np.int64), *(leading(*found, idf) for found in _terms(batch))])


def deal(rows: DataFrame, idf: Broadcast, total: int, p: Packing) -> DataFrame:
    """``rows`` with their shard."""
    tree = Dealing(total, p.shard_tokens)
    if total <= p.shard_tokens:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    names = [f"k{i}" for i in range(KEYS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("n"), *map(pa.array, np.ascontiguousarray(_keys(batch, idf.value).T))], names=["n", *names])

    keys = materialize(rows.select("n", "ids").mapInArrow(place, "n long, " + ", ".join(f"{k} long" for k in names)), "packing-keys")
    for _ in range(KEYS):
        if not tree.divide():
            break
        known = rows.sparkSession.sparkContext.broadcast(tree)

        def count(batches: Iterator[pa.RecordBatch], known: Broadcast = known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes, where = np.unique(known.value.node(np.stack([batch.column(k).to_numpy() for k in names], 1)), return_inverse=True)
                tokens = np.bincount(where, batch.column("n").to_numpy(), len(nodes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tokens)], names=["node", "tokens"])

        met = keys.mapInArrow(count, "node long, tokens long").where(F.col("node") >= tree.edge[-1]).groupBy("node").agg(F.sum("tokens").alias("tokens")).toPandas()
        tokens = np.zeros(int(tree.bins[tree.child >= tree.edge[-1]].sum()), np.int64)
        tokens[met["node"].to_numpy(np.int64) - tree.edge[-1]] = met["tokens"].to_numpy(np.int64)
        tree.fill(tokens)
    whole = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = whole.value.shard(_keys(batch, idf.value), batch.column("spread").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "ids")), pa.array(shard)], names=["doc_id", "n", "ids", "shard"])

    # rows come from a written table, so a task that runs again finds the same places; without them repeated rows would share a shard
    return rows.withColumn("spread", F.xxhash64("doc_id", F.crc32("ids"), F.monotonically_increasing_id())).mapInArrow(run, "doc_id long, n long, ids binary, shard long")


class Shard:
    """Inverted index of a shard's documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, p: Packing):
        self.p, self.ids = p, ids
        owner, terms, counts = counted(ids)
        sizes = np.bincount(owner, minlength=len(ids))
        counts = counts.astype(np.float64)
        length = np.array([len(x) for x in ids], np.float64)[owner]
        weight = idf[terms] * counts * (p.k1 + 1) / (counts + p.k1 * (1 - p.b + p.b * length / mean))
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.heads = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.ends = np.cumsum(sizes)
        self.terms = terms

    def drop(self, left: np.ndarray) -> None:
        """Takes the documents that aren't ``left`` out of the index; they can still be queries."""
        keep = left[self.owner]
        self.heads = np.append(0, np.cumsum(keep))[self.heads]
        self.owner, self.weight = self.owner[keep], self.weight[keep]

    def query(self, d: int) -> np.ndarray:
        """The terms of document ``d``."""
        return self.terms[self.ends[d - 1] if d else 0 : self.ends[d]]

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every document against ``d``."""
        terms = self.query(d)
        heads = self.heads[terms]
        sizes = self.heads[terms + 1] - heads
        ends = np.cumsum(sizes)
        at = np.repeat(heads - ends + sizes, sizes)
        at += np.arange(len(at))
        return np.bincount(self.owner[at], self.weight[at], len(self.ids))


def nearest(scores: np.ndarray, block: int = 64) -> Iterator[int]:
    """All places of positive score, best first and ties by place, sorted block by block as they are asked for."""
    rest = np.flatnonzero(scores > 0)
    while len(rest):
        values = scores[rest]
        now = values >= (np.partition(values, len(rest) - block)[len(rest) - block] if len(rest) > block else 0)
        some, rest = rest[now], rest[~now]
        yield from some[np.lexsort((some, -scores[some]))].tolist()
        block *= 4


def order(shard: Shard, window: int) -> list[int]:
    """All documents: each seed is followed by its best unused neighbours until a window is full; a window that begins with
    the rest of a document goes on with that document's neighbours."""
    n = len(shard.ids)
    left = np.ones(n, bool)
    out: list[int] = []
    seed, room, last, indexed = 0, window, None, n
    while len(out) < n:
        if last is None:
            while not left[seed]:
                seed += 1
            last = seed
            left[seed] = False
            out.append(seed)
            room -= len(shard.ids[seed])
        if room > 0:
            if indexed - (n - len(out)) > indexed // 8:
                shard.drop(left)
                indexed = n - len(out)
            scores = shard.scores(last)
            scores[~left] = -1.0
            for d in nearest(scores):
                left[d] = False
                out.append(d)
                room -= len(shard.ids[d])
                last = d
                if room <= 0:
                    break
        if room <= 0:
            over = -room % window
            room, last = window - over, last if over else None
        else:
            last = None
    return out


def lengths(total: int, p: Packing) -> list[int]:
    """Lengths of the sequences that ``total`` ids fill."""
    out, rest = [p.window] * (total // p.window), total % p.window
    while rest:
        size = 1 << rest.bit_length() - 1
        if rest < 2 * p.least_piece or rest - size == 0:
            out.append(rest)
            break
        out.append(size)
        rest -= size
    return out


def pack(docs: DataFrame, tokenizer: str, end: int, p: Packing | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one a piece."""
    p = p or Packing()
    spark = docs.sparkSession
    rows = materialize(encode(docs, tokenizer, end, key, text), "packing")
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = frequencies(rows).toPandas()  # a row for each id of the vocabulary at most
    df = np.zeros(int(known["term"].max()) + 1 if len(known) else 1, np.int64)
    df[known["term"].to_numpy(np.int64)] = known["df"].to_numpy()
    idf = spark.sparkContext.broadcast(np.log1p((count - df + 0.5) / (df + 0.5)))
    mean = total / max(count, 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(sorted(range(table.num_rows), key=lambda i, a=table.column("doc_id").to_pylist(), b=table.column("ids").to_pylist(): (a[i] is not None, a[i] or 0, b[i]))))
        keys, raws, shard_no = table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), table.column("shard")[0].as_py()
        ids = [np.frombuffer(r, _kind(n, r)) for n, r in zip(table.column("n").to_pylist(), raws)]
        sequence, taken, out = 0, 0, []
        sizes = lengths(sum(map(len, ids)), p)
        for d in order(Shard(ids, idf.value, mean, p), p.window):
            wide, at = ids[d].astype("<u4"), 0
            while at < len(wide):
                step = min(len(wide) - at, sizes[sequence] - taken)
                raw = wide[at : at + step].tobytes()
                out.append((keys[d], at, step, zlib.crc32(raw), len(wide), shard_no << 32 | sequence, taken, *([raw] if with_ids else [])))
                at, taken = at + step, taken + step
                if taken == sizes[sequence]:
                    sequence, taken = sequence + 1, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        return pa.table([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names=names)

    dealt = deal(rows, idf, total, p)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.groupBy("shard").applyInArrow(run, schema)


#: The registered query's tokenizer file and end id.
TOKENIZER, END = "word_bpe_49k.json", 1


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import tokenizer_path

    return pack(documents(spark, sf_dir), tokenizer_path(TOKENIZER), END)
