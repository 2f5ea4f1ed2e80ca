"""Readers: strict JSON lines, JSON documents, image bytes, dataset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import content_id, image_extension


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON lines file with file and place; blank lines are skipped, and a line that is no object or has a value of
    another type raises.

    Lines end at line feeds only, so other separators inside strings survive. A line's place is the begin of its split in the
    file and, inside it, its turn: it grows along each file, however files are dealt to tasks.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("position"))
    lines = lines.where(F.length(F.trim("value")) > 0)
    parsed = F.when(F.trim("value").startswith("{"), F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}))
    valid = F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))
    row = F.when(valid, parsed).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))))
    return lines.select("file", "position", row.alias("_row")).select("file", "position", "_row.*")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_image_files(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """Rows (path, relative_path, length, image_id, extension, content); hidden names are left out. Columns that aren't asked for aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    relative = F.regexp_replace(F.col("path"), "^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    rows = files.select("path", relative.alias("relative_path"), "length", content_id(F.col("content")).alias("image_id"), image_extension(F.col("content")).alias("extension"), "content")
    return rows.where(~F.col("relative_path").rlike(r"(^|/)\."))


def verify_objects(references: DataFrame, files: DataFrame, path: str, expected: str) -> DataFrame:
    """References with ``verified``: the bytes at their path hash to what they expect; null when there is no file."""
    found = files.select(F.col("path").alias(path), F.col("image_id").alias("_found"))
    return references.join(found, path, "left").withColumn("verified", F.col("_found") == F.col(expected)).drop("_found")


def resolve_path(references: DataFrame, listing: DataFrame, candidates: list[str]) -> DataFrame:
    """Adds ``resolved``: the one of several candidate paths that exists, null when none or more than one does."""
    rows, hits = references, []
    for i, column in enumerate(candidates):
        there = listing.select(F.col("path").alias(column), F.col("path").alias(f"_hit{i}")).distinct()
        rows = rows.join(there, column, "left")
        hits.append(F.col(f"_hit{i}"))
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return rows.withColumn("resolved", F.when(F.size(found) == 1, F.get(found, F.lit(0)))).drop(*[f"_hit{i}" for i in range(len(candidates))])


def unique_names(entries: DataFrame, files: DataFrame, name: str, path: str) -> DataFrame:
    """Adds the file that each entry names: by exact path, else by a base name that only one file has, with a reason when there is none."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    exact = files.select(F.col(path).alias(name), F.col(path).alias("_exact"))
    single = files.groupBy(base(path).alias("_base")).agg(F.count(F.lit(1)).alias("_n"), F.min(path).alias("_only"))
    rows = entries.withColumn("_base", base(name)).join(exact, name, "left").join(single, "_base", "left")
    unsafe = F.col(name).rlike(r"(^/)|(^|/)\.\.(/|$)")
    chosen = F.when(~unsafe, F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only"))))
    reason = F.when(unsafe, "unsafe").when(chosen.isNull() & (F.col("_n") > 1), "ambiguous").when(chosen.isNull(), "missing")
    return rows.select(*entries.columns, chosen.alias("resolved"), reason.alias("reason"))
