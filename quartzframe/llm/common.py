"""What the operators share: shared scratch tables, hot-key joins, ordered buckets, components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot when it holds at least 1/HOT_SHARE of the rows; by pigeonhole at most HOT_SHARE keys are.
HOT_SHARE = 256
#: Keys of fewer rows are no burden to a task, whatever their share.
HOT_ROWS = 1000
#: Slots of the bounded filters that keep rows which cannot match out of a shuffle.
FILTER_SLOTS = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a local master gets a temporary
    one; a cluster is refused, as its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quartzframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _MADE.append(path := f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return path


#: Scratch paths that this process has handed out and not freed.
_MADE: list[str] = []


#: With it, shuffle files go when the table that they were for is written, and not when their plan is forgotten.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while an operator runs its own queries; they are set back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later stages neither recompute it nor depend on its executors."""
    spark = df.sparkSession
    text_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*frames: DataFrame) -> None:
    """Deletes the scratch tables of frames that ``materialize`` gave; nothing that reads them may run afterwards."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            _delete(df.sparkSession, [path])


def scratch_mark() -> int:
    """To be handed to ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the scratch tables made since ``since`` but that of ``keep``. For callers whose result is written elsewhere."""
    _delete(spark, [p for p in _MADE[since:] if p != getattr(keep, "scratch_path", None)])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list[int] | None = None, salts: int = 64) -> DataFrame:
    """Joins on ``keys`` where a key of ``left`` may hold a third of all rows; ``right`` has few rows a key.

    ``hot`` are the hashes of hot keys as ``hot_keys`` gives them (then ``left`` should be a written table). Rows
    of a hot key are dealt over ``salts`` tasks, and the matching rows of ``right`` are repeated for
    each of them; all other keys are joined as usual.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    a = left.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE, least: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys that hold at least 1/``share`` of the rows and ``least`` rows: at most ``share`` of them."""
    seen = Observation()
    counts = df.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = counts.where(F.col("_n") >= least).orderBy(F.col("_n").desc(), "_h").limit(share).collect()
    return [r["_h"] for r in top if r["_n"] * share >= (seen.get["total"] or 0)] if top else []


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, longer where a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def slot(column: Column, slots: int = FILTER_SLOTS) -> Column:
    """The place of a 64-bit hash in a bounded filter."""
    return F.pmod(column, F.lit(slots)).cast("int")


def within_slots(df: DataFrame, column: Column, wanted: DataFrame, wanted_column: Column, slots: int = FILTER_SLOTS, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose hash shares a slot with one of ``wanted``, or without ``keep`` the others.

    The broadcast side has at most ``slots`` distinct integers whatever the input. Rows that
    pass by chance are for the exact join that follows to drop; at sizes where every slot
    is taken the filter lets all rows through and only its gain is lost.
    """
    taken = wanted.select(slot(wanted_column, slots).alias("_slot")).distinct()
    return df.withColumn("_slot", slot(column, slots)).join(F.broadcast(taken), "_slot", "left_semi" if keep else "left_anti").drop("_slot")


def within_bits(df: DataFrame, column: Column, wanted: DataFrame, wanted_column: Column, words: int = FILTER_SLOTS) -> DataFrame:
    """As ``within_slots``, with 64 slots in each of the broadcast side's numbers: it still holds back rows where every slot of that is taken."""
    word = lambda c: F.pmod(F.shiftrightunsigned(c, 6), F.lit(words)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))
    taken = wanted.select(word(wanted_column).alias("_taken"), bit(wanted_column).alias("_bit")).groupBy("_taken").agg(F.bit_or("_bit").alias("_bits"))
    rows = df.withColumn("_word", word(column)).withColumn("_bit", bit(column))
    held = (F.col("_word") == F.col("_taken")) & (F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return rows.join(F.broadcast(taken), held, "left_semi").drop("_word", "_bit")  # Spark would move a later semi-join below an inner one


def ordered_buckets(df: DataFrame, key: str, per_bucket: int = 2048, most: int = 1 << 15) -> Callable[[DataFrame], DataFrame]:
    """Cuts the order of an integer ``key`` into ranges of about ``per_bucket`` rows, and gives a function that adds a row's
    range as ``_bucket`` (-1 for a null key) to a frame with that key.

    The span of ids is cut evenly first, and each part again between its own least and largest id by the rows that it
    holds, so that a few ids far from the rest don't leave all others in one range. There are at most ``most`` parts and as many
    further ranges, whatever the input, so a row for each may be broadcast or meet in one task.
    """
    k = F.col(key).cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    width = F.greatest(F.lit(1.0), F.ceil((F.max(k) - F.min(k) + 1).cast("double") / F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.count(key) / per_bucket)))).cast("decimal(20,0)")
    bounds = df.agg(F.coalesce(F.min(k), zero).alias("_low"), F.coalesce(width, F.lit(1).cast("decimal(20,0)")).alias("_width"), F.greatest(F.lit(float(per_bucket)), F.count(key) / most).alias("_per"))
    first = F.floor((k - F.col("_low")) / F.col("_width")).cast("long")
    found = df.select(key).join(F.broadcast(bounds)).where(k.isNotNull()).groupBy(first.alias("_part")).agg(F.min(k).alias("_from"), F.max(k).alias("_to"), F.count(F.lit(1)).alias("_n"), F.max("_per").alias("_per"))
    parts = F.ceil(F.col("_n") / F.col("_per")).cast("long")
    before = F.coalesce(F.sum(parts).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.greatest(F.lit(1.0), F.ceil((F.col("_to") - F.col("_from") + 1).cast("double") / parts)).cast("decimal(20,0)")
    cuts = found.select("_part", "_from", step.alias("_step"), parts.alias("_parts"), before.alias("_before"))

    def place(frame: DataFrame) -> DataFrame:
        rows = frame.join(F.broadcast(bounds)).withColumn("_part", first).join(F.broadcast(cuts), "_part", "left")
        inside = F.least(F.col("_parts") - 1, F.floor((k - F.col("_from")) / F.col("_step")).cast("long"))
        return rows.select(*frame.columns, F.coalesce(F.col("_before") + inside, F.lit(-1)).alias("_bucket"))

    return place


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b): rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps over frames in the shared folder until no link
    changes. The driver sees two figures a round, observed while the links are written, and never a
    link. Each step takes minima (aggregated before the shuffle) and joins them back by a plain join,
    which adaptive execution splits where a hub is large; the links of the step before are deleted.
    """

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        rows = pairs.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        return materialize(rows, name), tuple(seen.get.values())

    edges, mark = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        near = edges.select(F.col("b").alias("_k"), F.col("b").alias("_n")).union(edges)
        least = near.groupBy("_k").agg(F.min("_n").alias("_m"))
        large, _ = written(edges.withColumnRenamed("b", "_k").join(least, "_k").select("a", F.col("_m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        both = F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))
        (new, now) = written(large.join(low, "a").select(F.explode(both).alias("e")).select("e.a", "e.b"))
        free(edges, large)
        edges, last, mark = new, mark, now
        if last == mark:
            break
    else:
        raise RuntimeError(f"{name}: no fixed point after {max_rounds} rounds")
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.union(edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component")))


@functools.cache
def ascii_lower() -> tuple[str, str]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return upper, upper.lower()


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(column, *ascii_lower())


#: Rows of whole texts that a Python worker gets at once, at most.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: rows here are whole texts, and a worker holds several copies of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
