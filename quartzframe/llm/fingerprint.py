"""Canonical exact digests of documents, in DataFrame operations only.

A text is normalised (Unicode NFKC), folded in case, its white space runs made one space
and its ends trimmed; the canonical text's two seeded 64-bit xxhashes are its bucket.
Inside a bucket of several rows, each canonical text is compared byte for byte with the
bucket's first document; texts that differ although their digests agree get a further
ordinal, so that equal fingerprints mean equal canonical texts.

Defined cases: a null text counts as empty; the empty text is a text like others. Equal
texts have equal fingerprints, repeated rows included. Rows with a null id are kept and
come first in the order. An empty table gives an empty result. Only the named columns
are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, keyed_join, materialize, ordered_buckets, within_bits

SEEDS = (0x5EED, 0xC0FFEE)


def canonical(text: Column) -> Column:
    """NFKC, case folded, white space runs as one space, trimmed."""
    plain = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.lower(F.upper(plain))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def digest(canon: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a canonical text."""
    return F.xxhash64(F.lit(SEEDS[0]), canon), F.xxhash64(F.lit(SEEDS[1]), canon)


def name(a: Column, b: Column, ordinal: Column) -> Column:
    """Fingerprint as text: 32 hex digits and, after a real collision, the ordinal."""
    text = F.concat(F.lpad(F.lower(F.hex(a)), 16, "0"), F.lpad(F.lower(F.hex(b)), 16, "0"))
    return F.when(F.coalesce(ordinal, F.lit(0)) > 0, F.concat(text, F.lit("-"), ordinal.cast("string"))).otherwise(text)


def collided(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, _h0, _h1, ordinal) of documents whose canonical text differs from that of their bucket's first: almost always none.

    Buckets of several rows are marked in a bounded filter, and only texts that it lets through are shuffled, once: a task sends
    each different text of a bucket once, and a bucket keeps its different texts, of which there is one unless digests collided.
    """
    canon = canonical(F.coalesce(F.col(text), F.lit("")))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), canon.alias("_canon"))
    hashed = rows.select("_id", "_canon", *(h.alias(f"_h{i}") for i, h in enumerate(digest(F.col("_canon")))))
    several = hashed.groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = within_bits(hashed, F.col("_h0"), several, F.col("_h0"))
    clashes = materialize(again.groupBy("_h0", "_h1").agg(F.size(F.collect_set("_canon")).alias("_n")).where("_n > 1").select("_h0", "_h1"), "clashes")
    if clashes.isEmpty():
        return hashed.select(F.col("_id").alias(key), "_h0", "_h1", F.lit(0).alias("ordinal")).limit(0)
    members = hashed.join(clashes, ["_h0", "_h1"], "left_semi")
    firsts = members.groupBy("_h0", "_h1").agg(F.min(F.struct("_id", "_canon"))["_canon"].alias("_kept"))
    odd = keyed_join(members, firsts, ["_h0", "_h1"]).where("_canon <> _kept")
    ranks = odd.select("_h0", "_h1", "_canon").distinct().withColumn("ordinal", F.row_number().over(Window.partitionBy("_h0", "_h1").orderBy("_canon")))
    return odd.join(ranks, ["_h0", "_h1", "_canon"]).groupBy(F.col("_id").alias(key), "_h0", "_h1").agg(F.min("ordinal").alias("ordinal"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, next): each document's text (null: empty) and that of the next in ascending key, after the last the first.

    Ids are cut into a bounded number of ranges and ordered inside each; a range also gets
    the first document of the following one. The broadcast and the single task hold one
    row a range.
    """
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    place = ordered_buckets(docs.select(F.col(key).alias("_id")), "_id")
    placed = place(rows)
    firsts = place(docs.select(F.col(key).alias("_id"))).groupBy("_bucket").agg(F.min("_id").alias("_id"))
    every = Window.orderBy("_bucket")
    ends = firsts.select("_id", "_bucket", F.lag("_bucket").over(every).alias("_to"), F.last("_bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"))
    borders = ends.select("_id", "_bucket", F.coalesce("_to", "_end").alias("_to"))
    same = placed["_id"].eqNullSafe(borders["_id"]) & (placed["_bucket"] == borders["_bucket"])
    heads = placed.join(F.broadcast(borders), same).select(placed["_id"], "_text", "_to")
    heads = heads.groupBy("_to").agg(F.min(F.struct("_id", "_text")).alias("_h")).select("_h._id", "_h._text", F.col("_to").alias("_bucket"), F.lit(True).alias("_head"))
    both = placed.withColumn("_head", F.lit(False)).unionByName(heads)
    order = Window.partitionBy("_bucket").orderBy("_head", F.col("_id").asc_nulls_first(), "_text")
    follow = both.withColumn("_next", F.lead("_text").over(order)).where(~F.col("_head"))
    return follow.select(F.col("_id").alias(key), F.col("_text").alias(text), F.coalesce("_next", F.lit("")).alias("next"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, fingerprint, group_size): documents with equal fingerprints are exact copies in canonical form."""
    canon = canonical(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), canon.alias("_canon"))
    rows = rows.select(key, "n_chars", *(h.alias(f"_h{i}") for i, h in enumerate(digest(F.col("_canon")))))
    rows = rows.join(collided(docs, key, text), [key, "_h0", "_h1"], "left")
    named = materialize(rows.select(key, "n_chars", name(F.col("_h0"), F.col("_h1"), F.col("ordinal")).alias("fingerprint")), "fingerprints")
    return keyed_join(named, named.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size")), ["fingerprint"])


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text: the last quarter replaced by the next document's beginning.

    An exact digest knows only equal and different, so likeness is 1 where the digests
    agree and the canonical bytes do too, else 0.
    """
    part = F.floor(F.length(text) / 4).cast("int")
    rows = with_next(docs, key, text).withColumn("n_chars", F.length(text).cast("long"))
    rows = rows.withColumn("_edited", F.concat(F.col(text).substr(F.lit(1), F.length(text) - part), F.col("next").substr(F.lit(1), part)))
    rows = rows.select(key, "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), canonical(F.col(text)).alias("_c"), canonical(F.col("_edited")).alias("_e"), canonical(F.col("next")).alias("_x"))
    (a, b), (c, d) = digest(F.col("_c")), digest(F.col("_e"))
    rows = rows.select(key, "n_chars", "edited_sha256", a.alias("_a"), b.alias("_b"), c.alias("_ea"), d.alias("_eb"), (F.col("_c") == F.col("_e")).cast("double").alias("near_edited"), (F.col("_c") == F.col("_x")).cast("double").alias("near_next"))
    rows = rows.join(collided(docs, key, text).toDF(key, "_a", "_b", "ordinal"), [key, "_a", "_b"], "left")
    same = F.when(F.col("near_edited") == 1, F.col("ordinal"))
    return rows.select(key, "n_chars", "edited_sha256", name(F.col("_a"), F.col("_b"), F.col("ordinal")).alias("fingerprint"), name(F.col("_ea"), F.col("_eb"), same).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
