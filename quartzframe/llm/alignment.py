"""Alignment of two tokenizers' tokens by the bytes that they cover, as joins, windows and aggregations.

Both tokenizers always cut at a space between two visible characters (a vocabulary's pieces and the pre-tokenizer
are looked at to be sure of it; otherwise a text is one stretch), so a text is a sequence of words, and each
different word of the corpus is tokenized and aligned once: tokens are exploded with their place, lengths are summed over
a window, tokens that end at one byte meet by an equi-join on word and end, a running count of such cuts numbers the groups, and each
different end stands for the link of the two tokens that cover the byte before it. Documents are kept in a bucketed
table; their exploded words meet the aligned ones inside a bucket, without a further shuffle, and are summed up as a stream in order.

Rows of the result for every row of the table: n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of
their first id), count_sum (counts added over links) and groups_sha256. A pair's count is the number of rows whose text links it.

Defined cases: a null or empty text, or one whose tokens' bytes aren't a space and the text, has no tokens: zeros and an
empty string, and it counts for no pair. Repeated rows, and rows of one id or of none, are documents of their own. Long texts are
read whole; a stretch without spaces is one word. Ties for the highest count all count. An empty table gives an empty result. Only the
named columns are read, so further columns never clash.

The result is a written table, as the joins rely on a setting that must hold while they run (see ``settings``).
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHUFFLES_GO, documents, free, keyed_join, materialize, scratch_path, settings, text_batches
from .token_store import tokenizer_path

#: Characters of text that a bucket holds about; visible words that are tokenized in one call.
BUCKET_CHARS, RUN = 16_000_000, 100
#: A space between two characters that no version of Unicode holds for white space.
BORDER = r" (?<=[\p{L}\p{N}\p{P}] )(?=[\p{L}\p{N}\p{P}])"
#: Rows of pairs' counts that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@functools.lru_cache(maxsize=4)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def tokenizers_of(first: str, second: str) -> tuple:
    """Both tokenizers and the bytes of each of their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(first)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=second)
    letters = byte_alphabet()
    a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in a.get_vocab().items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
    return a, b, a_bytes, b_bytes


@functools.lru_cache(maxsize=4)
def cut_at_spaces(first: str, second: str) -> bool:
    """Whether neither tokenizer can have a token across a space between visible characters."""
    with open(first, encoding="utf-8") as f:
        kind = json.load(f)
    before = kind.get("pre_tokenizer") or {}
    b = tokenizers_of(first, second)[1]
    whole = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
    return bool(whole) and not any(re.search("[^▁]▁", b.id_to_piece(i)) for i in range(b.get_piece_size()))


def visible(word: str) -> bool:
    """Whether a word begins and ends as the words between two borders do."""
    return bool(word) and all(unicodedata.category(c)[0] in "LNP" for c in (word[0], word[-1]))


def tokens(words: DataFrame, first: str, second: str) -> DataFrame:
    """Rows (word, same, a, a_n, b, b_n): ids of both kinds and their bytes; same: whether both give a space and the word."""
    cuttable = cut_at_spaces(first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, a_bytes, b_bytes = tokenizers_of(first, second)
        sides = [(lambda t: a.encode(" " + t, add_special_tokens=False).ids, a_bytes), (b.encode, b_bytes)]  # the second puts a space before
        lengths = [np.array([len(by[i]) for i in range(max(by) + 1)] if isinstance(by, dict) else [len(x) for x in by], np.int32) for by in (a_bytes, b_bytes)]

        def tokenized(part: list[str]) -> list[tuple[bool, list]]:
            """(same, [(ids, tokens of each word)] of both kinds) of words, as one text if that gives its bytes, else one by one."""
            text = " ".join(part)
            ids = [np.array(encode(text), np.int32) for encode, _ in sides]
            raw = (" " + text).encode()
            if all(b"".join([by[i] for i in x.tolist()]) == raw for x, (_, by) in zip(ids, sides)):
                stops = np.cumsum([1 + len(w.encode()) for w in part])
                return [(True, [(x, np.diff(np.searchsorted(np.cumsum(n[x]), stops, side="left") + 1, prepend=0)) for x, n in zip(ids, lengths)])]
            if len(part) == 1:
                return [(False, [(x, np.array([len(x)])) for x in ids])]
            return [found for w in part for found in tokenized([w])]

        for batch in batches:
            all_words = batch.column(0).to_pylist()
            runs = [w for w in all_words if cuttable and visible(w)]
            alone = [w for w in all_words if not (cuttable and visible(w))]
            found = [f for k in range(0, len(runs), RUN) for f in tokenized(runs[k : k + RUN])] + [f for w in alone for f in tokenized([w])]
            columns = [pa.array(runs + alone, pa.string()), pa.array([same for same, both in found for _ in both[0][1]], pa.bool_())]
            for k, n in enumerate(lengths):
                ids = np.concatenate([both[k][0] for _, both in found] or [np.zeros(0, np.int32)])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([both[k][1] for _, both in found] or [np.zeros(0, np.int64)]))]), pa.int32())
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, n[ids])]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "same", "a", "a_n", "b", "b_n"])

    return words.mapInArrow(run, "word string, same boolean, a array<int>, a_n array<int>, b array<int>, b_n array<int>")


def ends(tokenized: DataFrame, side: str) -> DataFrame:
    """Rows (word_id, end, id): where each token of a word ends."""
    rows = tokenized.select("word_id", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_n").alias("n"))).alias("_pos", "_token"))
    so_far = Window.partitionBy("word_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("word_id", F.sum("_token.n").over(so_far).cast("int").alias("end"), F.col("_token.id").alias(f"{side}_id"))


def aligned(tokenized: DataFrame) -> DataFrame:
    """Rows (word_id, end, a_id, b_id, link, group): a row for each different end; a_id and b_id are the tokens that end there, if any,
    link those that cover the byte before it, as one number. Groups are numbered from a word's last."""
    both = ends(tokenized, "a").join(ends(tokenized, "b"), ["word_id", "end"], "full")
    back = Window.partitionBy("word_id").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    cover = {s: F.last(f"{s}_id", ignorenulls=True).over(back).cast("long") for s in ("a", "b")}
    link = F.shiftleft(cover["a"], 32).bitwiseOR(cover["b"])
    return both.select("word_id", "end", "a_id", "b_id", link.alias("link"), F.sum(cut.cast("int")).over(back).alias("group"))


#: The groups of a word as text, folded over its ends in order: a cut closes a group.
GROUPS = """aggregate(_ends, struct('' AS done, '' AS a, '' AS b),
    (s, x) -> CASE WHEN x.a_id IS NOT NULL AND x.b_id IS NOT NULL
        THEN struct(concat(s.done, if(s.done = '', '', ';'), s.a, if(s.a = '', '', ','), x.a_id, '|', s.b, if(s.b = '', '', ','), x.b_id) AS done, '' AS a, '' AS b)
        WHEN x.a_id IS NOT NULL THEN struct(s.done AS done, concat(s.a, if(s.a = '', '', ','), x.a_id) AS a, s.b AS b)
        ELSE struct(s.done AS done, s.a AS a, concat(s.b, if(s.b = '', '', ','), x.b_id) AS b) END,
    s -> s.done)"""


def figures_of(rows: DataFrame) -> DataFrame:
    """Rows (word_id, n_a, n_b, n_groups, n_links, links, groups): figures of each word, its links, and its groups as text."""
    listed = F.sort_array(F.collect_list(F.struct("end", "a_id", "b_id", "link"))).alias("_ends")
    each = rows.groupBy("word_id").agg(F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"), F.max("group").alias("n_groups"), listed)
    return each.select("word_id", "n_a", "n_b", "n_groups", F.size("_ends").alias("n_links"), F.col("_ends.link").alias("links"), F.expr(GROUPS).alias("groups"))


def link_counts(linked: DataFrame) -> DataFrame:
    """Rows (link, count, best) of distinct rows (document columns, link): documents that hold a pair, and whether no pair of its first id has more."""
    counts = linked.groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    own = Window.partitionBy(F.shiftright("link", 32))  # as many rows as there are second ids at most
    return counts.select("link", "count", (F.col("count") == F.max("count").over(own)).alias("best"))


#: Words' figures that a Python worker gets at once, at most.
WORD_ROWS, BATCH = 30_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Settings that hold while the operator runs: a table bucketed by one of a join's keys isn't shuffled again for the others.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"} | SHUFFLES_GO


@contextlib.contextmanager
def bucketed(docs: DataFrame, words: str, key: str, text: str) -> Iterator[tuple[DataFrame, int]]:
    """Rows (bucket, row, doc_id, words) of a table bucketed by the bucket, in the shared folder; ``words`` is the SQL of a text's words;
    and how many buckets there are.

    Buckets are the least numbers that hash to each of the partitions, so each partition holds one bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    total = docs.agg(F.sum(F.length(F.col(text).cast("string")))).first()[0] or 0
    n = 1 + total // BUCKET_CHARS
    numbers = spark.range(40 * n + 200).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("_place"), F.col("id").cast("int").alias("bucket")).groupBy("_place").agg(F.min("bucket").alias("bucket"))
    placed = rows.withColumn("_place", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).join(F.broadcast(numbers), "_place", "left").withColumn("bucket", F.coalesce("bucket", "_place"))
    full = placed.repartition(n, "bucket").selectExpr("bucket", "row", "doc_id", f"{words} AS words")
    with kept(full, "bucket", n) as out:
        yield out, n


@contextlib.contextmanager
def kept(rows: DataFrame, by: str, n: int) -> Iterator[DataFrame]:
    """A written table of ``rows``, which are dealt by ``by`` to ``n`` tasks, bucketed by that column; it goes at the end."""
    spark = rows.sparkSession
    name, path = f"alignment_{uuid.uuid4().hex}", scratch_path(spark, "alignment")
    rows.write.option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(name)
    out = spark.table(name)
    out.scratch_path = path
    try:
        yield out
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        free(out)


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a stream of its words' figures, which come in order as the exploded words are the join's streamed side.

    A stream holds one document's sums at a time, where an aggregation would hold all texts of a bucket. A word out of its place raises.
    """
    names = ["doc_id", *COUNTS, "groups_sha256"]
    row, doc, at, same, sums, digest = None, None, 0, True, np.zeros(len(COUNTS), np.int64), None

    def done() -> tuple:
        return (doc, *(sums.tolist() if same else [0] * len(COUNTS)), digest.hexdigest() if same else "")

    for batch in batches:
        out: list[tuple] = []
        if batch.num_rows:
            rows, places = batch.column("row").to_numpy(), batch.column("pos").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            counts = np.stack([np.add.reduceat(np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64), begins) for c in COUNTS], axis=1)
            alike = np.logical_and.reduceat(batch.column("same").to_numpy(zero_copy_only=False).astype(bool), begins)
            # joined and taken by Arrow, as a Python object for each word costs more than its sums
            parts = pa.ListArray.from_arrays(pa.array(np.append(begins, batch.num_rows), pa.int32()), pc.fill_null(batch.column("groups"), ""))
            texts, docs = pc.binary_join(parts, ";").to_pylist(), batch.column("doc_id").take(pa.array(begins)).to_pylist()
            for k, (a, b) in enumerate(zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows])):
                if rows[a] != row:
                    if row is not None:
                        out.append(done())
                    row, doc, at, same, sums, digest = rows[a], docs[k], 0, True, np.zeros(len(COUNTS), np.int64), hashlib.sha256()
                if places[a] != at or (np.diff(places[a:b]) != 1).any():
                    raise ValueError("words of a document aren't in order")
                same, sums = same and bool(alike[k]), sums + counts[k]
                digest.update((";" * (at > 0) + texts[k]).encode())
                at += b - a
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names) - 1)] + [pa.array([r[-1] for r in out], pa.string())], names=names)
    if row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in done()[:-1]] + [pa.array([done()[-1]], pa.string())], names=names)


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for every row of ``docs``."""
    spark = docs.sparkSession
    text_batches(spark)
    words = "split(text, '" + BORDER.replace("\\", "\\\\") + "')" if cut_at_spaces(first, second) else "array(text)"
    with settings(spark, SETTINGS | {BATCH: spark.conf.get(BATCH)}), bucketed(docs, f"CASE WHEN length(text) > 0 THEN {words} END", key, text) as (rows, n):
        local = materialize(rows.select("bucket", F.explode("words").alias("word")).distinct(), "alignment-words")
        numbered = tokens(local.select("word").distinct(), first, second).withColumn("word_id", F.monotonically_increasing_id())
        with kept(numbered.repartition(n, "word_id"), "word_id", n) as tokenized:
            of_words = figures_of(aligned(tokenized.where("same").select("word_id", "a", "a_n", "b", "b_n")))
            figures = materialize(tokenized.select("word_id", "word", "same").join(of_words, "word_id", "left"), "alignment-figures")

        # documents that hold a pair
        own = rows.select("bucket", "row", F.explode(F.array_distinct("words")).alias("word"))
        odd = figures.where("not same")
        if not odd.isEmpty():
            bad = local.join(odd.select("word"), "word", "left_semi")
            bad = materialize(own.join(bad.hint("shuffle_hash"), ["bucket", "word"]).select("bucket", "row").distinct(), "alignment-odd")
            own = own.join(bad.hint("shuffle_hash"), ["bucket", "row"], "left_anti")
        near = materialize(local.join(figures.select("word", F.array_distinct("links").alias("links")), "word"), "alignment-near")
        met = own.join(near.hint("shuffle_hash"), ["bucket", "word"])
        counts = materialize(link_counts(met.select("bucket", "row", F.explode("links").alias("link")).distinct()), "alignment-best")
        free(near)

        # figures of a word, then of a document
        each = figures.select("word_id", F.explode("links").alias("link"))
        few = counts.count() <= MOST_BROADCAST
        each = each.join(F.broadcast(counts), "link") if few else keyed_join(each, counts, ["link"])
        scored = each.groupBy("word_id").agg(F.sum(F.col("best").cast("int")).alias("n_best"), F.sum("count").alias("count_sum"))
        full = materialize(figures.drop("links").join(scored, "word_id", "left").select("word", "same", "groups", *COUNTS), "alignment-words")
        free(figures, counts)
        here = materialize(local.join(full, "word").select("bucket", *full.columns), "alignment-here")
        free(local, full)
        placed = rows.select("bucket", "row", "doc_id", F.posexplode("words").alias("pos", "word")).join(here.hint("shuffle_hash"), ["bucket", "word"])
        given = placed.select("row", "doc_id", "pos", "same", "groups", *COUNTS).mapInArrow(totals, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "groups_sha256 string"]))
        none = rows.where("words IS NULL").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("groups_sha256"))
        spark.conf.set(BATCH, str(WORD_ROWS))  # rows are words here
        path = scratch_path(spark, "alignment")
        given.unionByName(none).write.parquet(path)
        out = spark.read.schema(given.schema).parquet(path)
        free(here)
    return out


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), tokenizer_path(FIRST), tokenizer_path(SECOND))
