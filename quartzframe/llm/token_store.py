"""Content-addressed store of token ids.

A rolling hash over the last 16 ids cuts each document's id stream into chunks, so equal
passages give equal chunks wherever they stand. A folder holds three Parquet tables:

- ``chunks`` (hash, n, ids): each different chunk once, ids as little-endian integers of 2 or 4 bytes;
- ``recipes`` (doc_id, start, n_tokens, hashes, root, part): the documents in ascending doc_id, each
  with its chunks' hashes in order and their Merkle root, ``start`` being the ids of all documents before it;
- ``manifest`` (part, docs, tokens, root): for each range of documents the Merkle root over theirs.

Readers rebuild documents from recipe and chunks and verify every hash and root.

Defined cases: a null or empty text has only the end id. Rows with a null id come first;
repeated rows are stored as documents of their own that share chunks, ordered by root. An
empty table gives empty tables. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, keyed_join, materialize, ordered_buckets, scratch_path, within_slots

#: Ids that a rolling hash covers, bits that must be zero at a cut, least and most ids of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 4096
MIX = np.uint32(0x9E3779B1)


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ids has its high bits zero: ends of possible chunks.

    Streams may stand one after another, as a cut lies more ids from its stream's begin than the hash covers.
    """
    gear = ids.astype(np.uint32) * MIX
    gear ^= gear >> np.uint32(15)
    rolled = gear.copy()
    for k in range(1, WINDOW):
        rolled[k:] += gear[:-k] << np.uint32(k)
    return np.flatnonzero((rolled * MIX) >> np.uint32(32 - CUT_BITS) == 0) + 1


def cut(places: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the stream from ``start`` to ``end``, given the possible ones inside it."""
    ends, last = [], start
    for p in [*places, end]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == end and p > last:
            last = p
            ends.append(p)
    return ends


def chunk_hash(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree; leaves and nodes are marked apart, an odd last node moves up."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack(raw: bytes) -> bytes:
    """Ids of 4 bytes, in 2 bytes each behind a mark where all fit."""
    ids = np.frombuffer(raw, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\4" + raw


def unpack(payload: bytes) -> bytes:
    return np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes() if payload[:1] == b"\2" else payload[1:]


@functools.lru_cache(maxsize=4096)
def _zeros(n: int) -> tuple[int, ...]:
    """The CRC-32 operator for ``n`` zero bytes, as 32 columns."""
    times = lambda m, v: functools.reduce(lambda a, i: a ^ m[i] if v >> i & 1 else a, range(32), 0)
    square = lambda m, k: tuple(times(m, c) for c in k)
    op, out = (0xEDB88320, *(1 << i for i in range(31))), tuple(1 << i for i in range(32))
    for _ in range(3):
        op = square(op, op)
    while n:
        if n & 1:
            out = square(op, out)
        op, n = square(op, op), n >> 1
    return out


def crc_join(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte runs after one another, the second of ``length`` bytes."""
    op = _zeros(length)
    for i in range(32):
        if first >> i & 1:
            second ^= op[i]
    return second


def encode(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, hashes, root, chunks); a chunk met before in the same task is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordbpe import word_bpe

        bpe, met = word_bpe(tokenizer), set()
        kinds = {"n_tokens": pa.int64(), "hashes": pa.list_(pa.binary()), "root": pa.binary(), "chunks": pa.list_(pa.binary())}
        for batch in batches:
            for at, plain, borders in bpe.parts(batch.column(1)):
                ids = np.insert(plain, borders[1:], end)
                bounds = (borders + np.arange(len(borders))).tolist()
                places = cut_places(ids)
                inside = np.searchsorted(places, bounds, side="right").tolist()
                places = places.tolist()
                narrow = ids.astype("<u2") if not len(ids) or ids.max() < 65536 else None
                out: dict[str, list] = {c: [] for c in kinds}
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    hashes, chunks = [], []
                    for stop in cut(places[inside[i] : inside[i + 1]], a, b) if b - a > LEAST else [b]:
                        payload = b"\2" + narrow[a:stop].tobytes() if narrow is not None else pack(ids[a:stop].tobytes())
                        hashes.append(h := chunk_hash(payload))
                        chunks.append(None if h in met else payload)
                        met.add(h)
                        a = stop
                    for c, v in zip(kinds, (bounds[i + 1] - bounds[i], hashes, merkle(hashes), chunks)):
                        out[c].append(v)
                keys = batch.column(0).slice(at, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(out[c], kinds[c]) for c in kinds)], names=["doc_id", *kinds])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, hashes array<binary>, root binary, chunks array<binary>")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes the three tables under ``folder``. Texts are encoded once; only chunks that may occur twice are shuffled."""
    rows = materialize(encode(docs, tokenizer, end, key, text), "encoded")
    chunks = rows.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("c")).select(F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("ids")).where("ids is not null")
    place = F.xxhash64("hash")
    again = rows.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("c")).where("c.chunks is not null").groupBy(F.col("c.hashes").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    shared = within_slots(chunks, place, again, place).groupBy("hash").agg(F.first("ids").alias("ids"))
    once = within_slots(chunks, place, again, place, keep=False)
    size = F.when(F.substring("ids", 1, 1) == F.lit(b"\2"), (F.length("ids") - 1) / 2).otherwise((F.length("ids") - 1) / 4).cast("int")
    once.unionByName(shared).select("hash", size.alias("n"), "ids").write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = rows.select("doc_id", "n_tokens", "hashes", "root")
    placed = ordered_buckets(recipes.select("doc_id"), "doc_id")(recipes).withColumnRenamed("_bucket", "part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("_own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(F.broadcast(sums), "part")
    ordered = ordered.select("doc_id", (F.col("_base") + F.col("_own")).alias("start"), "n_tokens", "hashes", "root", "part")
    ordered.repartitionByRange("part").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _manifest(recipes.sparkSession.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _manifest(recipes: DataFrame) -> DataFrame:
    """Rows (part, docs, tokens, root) of recipes as they are."""
    roots = F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda x: x["root"])
    tree = F.udf(lambda hashes: merkle([bytes(h) for h in hashes]), "binary", useArrow=True)
    return recipes.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), roots.alias("_roots")).select("part", "docs", "tokens", tree("_roots").alias("root"))


def _checked(chunks: DataFrame, with_ids: bool) -> DataFrame:
    """Rows (hash, n, crc[, ids]) of stored chunks; a chunk that doesn't fit its hash raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, payloads = batch.column("hash").to_pylist(), batch.column("ids").to_pylist()
            for h, p in zip(hashes, payloads):
                if chunk_hash(p) != h:
                    raise ValueError(f"chunk {h.hex()} is damaged")
            raws = [unpack(p) for p in payloads]
            columns = [pa.array(hashes, pa.binary()), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raws, pa.binary())] * with_ids, names=["hash", "n", "crc"] + ["ids"] * with_ids)

    return chunks.select("hash", "ids").mapInArrow(run, "hash binary, n long, crc long" + ", ids binary" * with_ids)


def _verified_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes, each range held against the manifest; a difference raises when rows are read."""
    recipes, manifest = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/manifest")
    found = _manifest(recipes).select("part", F.col("docs").alias("_d"), F.col("tokens").alias("_t"), F.col("root").alias("_r"))
    same = F.col("docs").eqNullSafe(F.col("_d")) & F.col("tokens").eqNullSafe(F.col("_t")) & F.col("root").eqNullSafe(F.col("_r"))
    both = manifest.join(found, "part", "full").select("part", F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("manifest differs in part "), F.col("part").cast("string")))).alias("_good"))
    # a row a range, and ranges are bounded in number
    return recipes.join(F.broadcast(both), "part").where("_good")


def _unique_recipes(recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (root, pos, hash, ...) of each different recipe with its chunks; a missing chunk has null fields."""
    unique = recipes.groupBy("root").agg(F.first("hashes").alias("hashes"))
    return keyed_join(unique.select("root", F.posexplode("hashes").alias("pos", "hash")), chunks, ["hash"], "left")


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files, without moving ids.

    Chunks are checked and summed where they are read; a document's sum is put together
    from those of its chunks, and its recipe is held against its root and the manifest.
    """
    recipes = _verified_recipes(spark, folder)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, sums = batch.column("root").to_pylist(), []
            for root, parts in zip(roots, batch.column("parts").to_pylist()):
                crc = n = 0
                for p in parts:
                    if p["crc"] is None:
                        raise ValueError(f"chunk {p['hash'].hex()} is missing")
                    crc, n = crc_join(crc, p["crc"], 4 * p["n"]) if n else p["crc"], n + p["n"]
                if merkle([p["hash"] for p in parts]) != root:
                    raise ValueError(f"recipe {root.hex()} is damaged")
                sums.append((n, crc))
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], names=["root", "n", "crc"])

    parts = _unique_recipes(recipes, _checked(spark.read.parquet(f"{folder}/chunks"), False))
    grouped = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "n", "crc"))).alias("parts"))
    sums = grouped.mapInArrow(combine, "root binary, n long, crc long")
    rows = keyed_join(recipes.select("doc_id", "start", "n_tokens", "root"), sums, ["root"], "left")
    n = F.when(F.col("n").eqNullSafe(F.col("n_tokens")), F.col("n")).otherwise(F.raise_error(F.lit("a document's length differs")).cast("long"))
    return rows.select("doc_id", "start", n.alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, ids) with the whole id streams as little-endian 32-bit integers."""
    recipes = _verified_recipes(spark, folder)
    parts = _unique_recipes(recipes, _checked(spark.read.parquet(f"{folder}/chunks"), True))
    ids = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p")).select("root", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["ids"], F.raise_error(F.lit("a chunk is missing")).cast("binary")))).alias("ids"))
    return keyed_join(recipes.select("doc_id", "start", "root"), ids, ["root"], "left").select("doc_id", "start", "ids")


#: The registered query's tokenizer file and end id.
TOKENIZER, END = "word_bpe_49k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    write(documents(spark, sf_dir), folder, tokenizer_path(), END)
    return read_facts(spark, folder)
