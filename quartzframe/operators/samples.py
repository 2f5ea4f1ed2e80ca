"""Confirmed samples of a dataset folder: manifests of batches, their annotations, and the objects that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: The version of manifests that is read, and the folder of batches.
MANIFEST_VERSION, BATCHES = 1, "batches"


def resolved_path(folder: Column, path: Column) -> Column:
    """``path`` seen from ``folder``, both below the root, without dots; null for an absolute path and for one that leaves the root on its way."""
    parts = F.split(F.concat_ws("/", folder, path), "/")
    none = F.lit(None).cast("array<string>")

    def step(made: Column, part: Column) -> Column:
        up = F.when(F.size(made) > 0, F.slice(made, 1, F.size(made) - 1)).otherwise(none)
        return F.when(part.isin("", "."), made).when(part == "..", up).otherwise(F.concat(made, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(~path.startswith("/"), F.nullif(joined, F.lit("")))


def whole_corners(corners: Column) -> Column:
    """Four corners cut to whole numbers; null for another number of them, or where one lacks two finite coordinates."""
    usable = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < 9e18), F.lit(False))
    bad = lambda p: ~(usable(F.get(p, F.lit(0))) & usable(F.get(p, F.lit(1))))
    cut = F.transform(corners, lambda p: F.array(F.get(p, F.lit(0)).cast("long"), F.get(p, F.lit(1)).cast("long")))
    return F.when((F.size(corners) == 4) & ~F.exists(corners, bad), cut)


def current_annotations(annotations: DataFrame) -> DataFrame:
    """Rows (batch, image_id, annotation_id, boundary_corners): each image's annotation that no other of its batch supersedes; two of them raise."""
    gone = annotations.where("supersedes_annotation_id is not null").select("batch", C("supersedes_annotation_id").alias("annotation_id")).distinct()
    heads = annotations.join(gone, ["batch", "annotation_id"], "left_anti")
    one = heads.groupBy("batch", "image_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("annotation_id", "boundary_corners")).alias("_head"))
    error = F.raise_error(F.concat(F.lit("image with several current annotations: "), C("image_id")))
    head = F.when(C("_n") == 1, C("_head")).otherwise(error)
    return one.select("batch", "image_id", head.alias("_head")).select("batch", "image_id", "_head.annotation_id", "_head.boundary_corners")


def named_objects(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows (batch, position, image_id, object_path) of entries whose path, seen from the batch or from the root, is exactly one object, and that one has the image's hash."""
    here = F.concat_ws("/", F.lit(BATCHES), C("batch"))
    ways = F.explode(F.array(resolved_path(here, C("object_path")), resolved_path(F.lit(""), C("object_path"))))
    seen = entries.where(C("schema_version") == MANIFEST_VERSION).select("batch", "position", "image_id", ways.alias("path")).where("path is not null")
    found = seen.join(objects.select("path", "object_hash"), "path")
    one = found.groupBy("batch", "position", "image_id").agg(F.count(F.lit(1)).alias("_n"), F.max("path").alias("object_path"), F.max("object_hash").alias("_hash"))
    return one.where((C("_n") == 1) & (C("_hash") == C("image_id"))).select("batch", "position", "image_id", "object_path")


def confirmed_samples(entries: DataFrame, annotations: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows (image_id, object_path, boundary_corners, annotation_id): each image as its last batch with a whole record of it has it.

    ``entries`` (batch, position, schema_version, image_id, object_path): manifests' images, a position once in its batch; ``annotations`` (batch,
    annotation_id, image_id, boundary_corners: array of arrays, supersedes_annotation_id); ``objects`` (path below the root with links followed,
    object_hash), a path once. Batches are ordered by name. Left out: manifests of other versions, images without an annotation in the same batch,
    objects that are missing, ambiguous, outside of the root or of another hash, and boundaries that aren't four finite points.
    """
    whole = current_annotations(annotations).withColumn("boundary_corners", whole_corners(C("boundary_corners"))).where("boundary_corners is not null")
    rows = named_objects(entries, objects).join(whole, ["batch", "image_id"])
    last = rows.groupBy("image_id").agg(F.max_by(F.struct("object_path", "boundary_corners", "annotation_id"), F.struct("batch", "position")).alias("_s"))
    return last.select("image_id", "_s.*")
