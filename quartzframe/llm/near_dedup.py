"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

A document's set is that of its 5-word shingles. Documents with one and the same set are
collapsed; the rest are signed by MinHash, banded, and folded into an odd sketch: a bitmap in
which each sample flips one bit, so that the population count of two sketches' XOR tells how
many samples differ. Inside a band's bucket every member is compared on the full sets with one
centre, the member whose bands meet the most others. Where a bucket still holds several
components, members outside that of its centre are compared across components: candidates are
those that the distances to the centre (Jaccard distance is a metric), the set sizes and two odd
sketches allow: that of the samples, and one of the whole sets, whose XOR never has more bits than the
sets have different members. Each candidate is confirmed on the full sets. So links are never listed for
all pairs of a group, and none between different sets is lost that the bands offer.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing. With fewer than five words the whole sequence is the one shingle. Repeated rows and rows of
one id are one node; ``filter_documents`` keeps each different text of a node that stays once, and all rows without
words. A row with a null id is kept and has a null component. An empty
table gives an empty result. Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, free, hot_keys, keyed_join, materialize, within_slots


@dataclass(frozen=True)
class NearDedup:
    """words: of a shingle; percent: least similarity; bands, rows: of the signature (a pair at 0.75 is missed with a chance of
    5e-6); samples: MinHash values folded into the odd sketch, of so many bits; floor: estimate below which a pair isn't
    confirmed, six standard deviations under the threshold; whole: bits of the whole sets' sketch; seed: of the hashes."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    samples: int = 256
    bits: int = 1024
    floor: float = 0.57
    whole: int = 2048
    seed: int = 11


class WordHashes(dict):
    """64-bit hashes of words; emptied by its user when large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


#: Words whose hashes a worker keeps, and rows that it signs at once.
MOST_WORDS, ROWS = 50_000, 256
_HASHES = WordHashes()
_WEIGHTS = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes fold A-Z only and split at space and \x09 to \x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > MOST_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    if len(h) < words:
        return mix((h * _WEIGHTS[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[: len(h) - words + 1] * _WEIGHTS[0]
    for i in range(1, words):
        total += h[i : len(h) - words + 1 + i] * _WEIGHTS[i]
    return np.unique(mix(total + np.uint64(words)))


@functools.lru_cache(maxsize=4)
def _family(p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the hash functions on 32 bits, a column each."""
    rng = np.random.default_rng(p.seed)
    size = max(p.samples, p.bands * p.rows)
    return rng.integers(0, 2**31, (size, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (size, 1), dtype=np.uint32)


def signature(found: np.ndarray, p: NearDedup) -> np.ndarray:
    """MinHash values of a non-empty set."""
    factor, offset = _family(p)
    out = np.full(len(factor), np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = short[None, at : at + 1024] * factor
        part += offset
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, p: NearDedup) -> np.ndarray:
    rows = sig[: p.bands * p.rows].astype(np.uint64).reshape(p.bands, p.rows)
    return mix((mix(rows) * _WEIGHTS[: p.rows]).sum(axis=1) + np.arange(p.bands, dtype=np.uint64)).view(np.int64)


def odd_sketch(sig: np.ndarray, p: NearDedup) -> np.ndarray:
    """Parity bitmap of the samples, as signed 64-bit words."""
    sig = sig[: p.samples].astype(np.uint64)
    places = mix(sig + np.arange(1, len(sig) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(p.bits)
    odd = np.bincount(places.astype(np.int64), minlength=p.bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def whole_sketch(found: np.ndarray, p: NearDedup) -> np.ndarray:
    """Parity bitmap of all members of a set."""
    odd = np.bincount((found % np.uint64(p.whole)).astype(np.int64), minlength=p.whole) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_differing(p: NearDedup) -> int:
    """The largest population count of an XOR whose estimate reaches the floor."""
    return int(p.bits / 2 * (1 - (1 - 2 / p.bits) ** (2 * p.samples * (1 - p.floor))))


def sketch_estimate(differing: int, p: NearDedup) -> float:
    """Similarity that a population count speaks for."""
    rest = 1 - 2 * differing / p.bits
    return 1 + math.log(rest) / (2 * p.samples * -math.log(1 - 2 / p.bits)) if rest > 0 else 0.0


def sketches(docs: DataFrame, p: NearDedup, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, set_key, bands, odd, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list[tuple] = []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = shingles(t, p.words)
                    if len(found):
                        sig = signature(found, p)
                        out.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), band_keys(sig, p).tolist(), odd_sketch(sig, p).tolist(), whole_sketch(found, p).tolist()))
                    else:
                        out.append((0, hashlib.blake2b(b"empty %r" % doc, digest_size=16).digest(), [], [], []))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), longs, longs, longs)))], names=["doc_id", "n_shingles", "set_key", "bands", "odd", "whole"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, odd array<long>, whole array<long>")


def differing(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similarities(pairs: DataFrame, docs: DataFrame, p: NearDedup, key: str = "doc_id", text: str = "text", group: int = 200) -> DataFrame:
    """The pairs (a, b) with ``same`` and ``all``: sizes of the intersection and union of their full sets.

    ``pairs`` is a written table. Texts of ids in no pair stay where they are. A centre ``b`` with many partners is
    dealt over groups of about ``group`` of them, each with its own copy of the centre's text. Where an id has
    several texts, the likest counts.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / group).alias("_groups"))
    hot = hot_keys(pairs, ["b"])
    dealt = keyed_join(pairs, many, ["b"], hot=hot).select("a", "b", F.pmod(F.xxhash64("a"), F.col("_groups")).alias("_g"))
    heads = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)).alias("_g"))
    ids = dealt.select(F.col("a").alias("_id"), "b", "_g", F.lit(False).alias("_centre")).union(heads.select(F.col("b"), "b", "_g", F.lit(True)))
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).where("_id is not null")
    met = pairs.select(F.explode(F.array("a", "b")).alias("_id"))
    texts = within_slots(texts, F.xxhash64("_id"), met, F.xxhash64("_id"))
    rows = keyed_join(ids, texts, ["_id"], hot=hot)  # an id has at most a row a band and group, so only centres can be hot

    def run(table: pa.Table) -> pa.Table:
        centres, others = [], []
        for i, t, c in zip(table.column("_id").to_pylist(), table.column("_text").to_pylist(), table.column("_centre").to_pylist()):
            (centres if c else others).append((i, shingles(t, p.words)))
        best: dict[int, tuple[int, int]] = {}
        for _, have in centres:
            for i, found in others:
                same = len(np.intersect1d(have, found, assume_unique=True))
                both = max(len(have) + len(found) - same, 1)
                if i not in best or same * best[i][1] > best[i][0] * both:
                    best[i] = same, both
        ids = sorted(best)
        centre = [table.column("b")[0].as_py()] * len(ids)
        return pa.table([pa.array(c, pa.int64()) for c in (ids, centre, [best[i][0] for i in ids], [best[i][1] for i in ids])], names=["a", "b", "same", "all"])

    return rows.groupBy("b", "_g").applyInArrow(run, "a long, b long, same long, all long")


def _observed(df: DataFrame, name: str, value: Column) -> tuple[DataFrame, int]:
    """``df`` written, and one figure about it that is taken on the way."""
    seen = Observation()
    out = materialize(df.observe(seen, value.alias("v")), name)
    return out, seen.get["v"] or 0


def _classes(signed: DataFrame, docs: DataFrame, p: NearDedup, key: str, text: str) -> DataFrame:
    """Rows (set_key, component) of the different sets in ``signed``."""
    members = signed.where("n_shingles > 0 and doc_id is not null")
    first = F.min_by(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands"), "doc_id")
    sets = materialize(members.groupBy("set_key").agg(first.alias("s")).select("set_key", "s.*"), "sets")
    places = sets.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    seen = Observation()
    buckets = materialize(sizes.observe(seen, F.sum("size").alias("total")).where("size > 1"), "buckets")
    large = max((seen.get["total"] or 0) // 2048, 1000)  # 2048 buckets at most are hot
    hot = [r["h"] for r in buckets.where(F.col("size") > large).select(F.xxhash64("bucket").alias("h")).collect()]
    inside = materialize(keyed_join(places, buckets, ["bucket"], hot=hot), "inside")
    linked = F.expr(f"100 * same >= {p.percent} * all")

    # each member against its bucket's centre
    met = inside.groupBy("id").agg(F.sum("size").alias("met"))
    centre = inside.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("m"))).alias("_c"))
    centre = centre.select("bucket", (-F.col("_c.m")).alias("b"))
    placed = materialize(keyed_join(inside, centre, ["bucket"], hot=hot).select("bucket", "id", "b"), "placed")
    free(inside, buckets)
    pairs = materialize(placed.where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "pairs")
    known = materialize(similarities(pairs, docs, p, key, text), "likeness")
    near = materialize(components(known.where(linked).select("a", "b"), "near"), "near")

    # across the components of a bucket
    distance = known.select(F.col("a").alias("id"), "b", (1 - F.col("same") / F.col("all")).alias("d"))
    state = placed.join(distance, ["id", "b"], "left").join(near.withColumnRenamed("component", "c"), "id", "left")
    state = state.select("bucket", "id", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("c", "id").alias("c"), (F.col("id") == F.col("b")).alias("centre"))
    state = materialize(state, "state")
    free(placed, pairs, known)
    main = F.min(F.when(F.col("centre"), F.col("c")))
    mixed = state.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), main.alias("main")).where("low <> high").select("bucket", "main")
    marks = members.select(F.col("doc_id").alias("id"), "set_key", F.col("n_shingles").alias("n"), "odd", "whole")
    marks = marks.join(sets.select("id", "set_key"), ["id", "set_key"], "left_semi").dropDuplicates(["id", "set_key"]).drop("set_key")
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / p.percent)).alias("bin")
    apart, rows = _observed(keyed_join(state, mixed, ["bucket"], hot=hot).join(marks, "id").select("*", step), "apart", F.count(F.lit(1)))
    free(state)
    classes = near
    if rows:
        more = similarities(materialize(_across(apart, p), "pairs"), docs, p, key, text).where(linked).select("a", "b")
        found, new = _observed(more, "links", F.count(F.lit(1)))
        if new:  # a component's members, linked with its smallest, stand for the links between them
            classes = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found), "near")
    return sets.select("set_key", "id").join(classes, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))


def _across(apart: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that distances, sizes and sketches allow to be linked.

    Sets of similar size lie in the same or the next of bins that are as wide as the threshold allows, so members meet by
    bucket and bin; hot ones are dealt over tasks.
    """
    names = ("id", "n", "odd", "whole", "d", "c")
    other = apart.where("c <> main").select("bucket", F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)])).alias("bin"), *(F.col(c).alias(f"{c}_a") for c in names))
    differ = (F.col("c") != F.col("c_a")) & ((F.col("c") == F.col("main")) | (F.col("id") < F.col("id_a"))) & ~F.col("centre")
    fits = (F.col("n") * 100 >= F.col("n_a") * p.percent) & (F.col("n_a") * 100 >= F.col("n") * p.percent) & (F.abs(F.col("d") - F.col("d_a")) <= 1 - p.percent / 100 + 1e-9)
    # the sets' difference is at most this share of their sizes; the bitmaps' is never larger
    few = differing(F.col("whole"), F.col("whole_a")) * (100 + p.percent) <= (F.col("n") + F.col("n_a")) * (100 - p.percent)
    pairs = keyed_join(other, apart, ["bucket", "bin"]).where(differ & fits & few & (differing(F.col("odd"), F.col("odd_a")) <= most_differing(p)))
    return pairs.select(F.col("id_a").alias("a"), F.col("id").alias("b")).distinct()


def _labelled(signed: DataFrame, named: DataFrame) -> DataFrame:
    out = keyed_join(signed.select("doc_id", "n_shingles", "set_key"), named, ["set_key"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, p: NearDedup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one a row of ``docs``."""
    p = p or NearDedup()
    signed = materialize(sketches(docs, p, key, text), "sketches")
    return _labelled(signed, _classes(signed, docs, p, key, text))


def filter_documents(docs: DataFrame, p: NearDedup | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, each of its different texts once."""
    p = p or NearDedup()
    signed = materialize(sketches(docs, p, key, text), "sketches")
    gone = _labelled(signed, _classes(signed, docs, p, key, text)).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    left = docs.join(gone, key, "left_anti")
    repeats = signed.where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    if repeats.isEmpty():
        return left
    return left.join(repeats, key, "left_anti").unionByName(left.join(repeats, key, "left_semi").dropDuplicates([key, text]))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM toks
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT a, a FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
comp AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id
"""
