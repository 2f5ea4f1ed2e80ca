"""Registered query of the reader of confirmed samples, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples
from .queries import register, table

C = F.col

# Documents are objects at the root; every eleventh also lies in its batches' folders. Each is named by two of four batches, in one of several ways.
SAMPLES_SQL = """WITH d AS (SELECT doc_id AS k, 'sha256:' || sha256(coalesce(text, '')) AS h FROM documents),
    e AS (SELECT k, h, b, 'o/' || k AS name FROM (SELECT k, h, unnest(list_distinct(['b' || k % 4, 'b' || k % 7 % 4])) AS b FROM d)),
    good AS (SELECT h, b, k FROM e WHERE k % 11 <> 1 AND k % 11 <> 2 AND k % 11 <> 3 AND b <> 'b3'),
    a AS (SELECT e.b, e.h, min(e.k) AS k, count(*) FILTER (quality = 1) AS q FROM e JOIN labels l ON l.doc_id = e.k GROUP BY 1, 2),
    n AS (SELECT *, [[1, q], [8, 1], [8, k % 50], [1 - q, 8]] AS c FROM a WHERE k % 13 <> 0 AND k % 17 <> 0),
    p AS (SELECT good.h AS h, first({'k': good.k, 'c': c, 'a': n.k} ORDER BY good.b DESC, good.k DESC) AS s FROM good JOIN n USING (h, b) GROUP BY 1)
    SELECT h AS image_id, 'o/' || s.k AS object_path, array_to_string([array_to_string(x, ' ') for x in s.c], ',') AS corners, 'n' || s.a AS annotation_id FROM p"""


@register("dataset_samples", SAMPLES_SQL)
def dataset_samples(spark: SparkSession, d: str) -> DataFrame:
    """Documents as archived images, labels as annotations that a second one supersedes, in four batches of which one has another version."""
    k, text = C("doc_id"), lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("image_id"))
    batches = F.explode(F.array_distinct(F.array(text("b", k % 4), text("b", k % 7 % 4)))).alias("batch")
    named = docs.select("doc_id", "image_id", batches)
    name = text("o/", k)
    way = F.when(k % 11 == 0, F.concat(F.lit("../../"), name)).when(k % 11 == 2, F.concat(F.lit("../../../"), name)).when(k % 11 == 4, F.concat(F.lit("x/.././/"), name)).otherwise(name)
    entries = named.select("batch", k.alias("position"), F.when(C("batch") == "b3", 2).otherwise(1).alias("schema_version"), "image_id", way.alias("object_path"))
    objects = docs.select(name.alias("path"), F.when(k % 11 == 3, F.lit("sha256:other")).otherwise(C("image_id")).alias("object_hash"))
    objects = objects.unionByName(named.where("doc_id % 11 = 1").select(F.concat(F.lit("batches/"), "batch", F.lit("/"), name).alias("path"), C("image_id").alias("object_hash")))
    labels = table(spark, d, "labels").select("doc_id", "quality")
    notes = named.join(labels, "doc_id").groupBy("batch", "image_id").agg(F.min("doc_id").alias("k"), F.count(F.when(C("quality") == 1, 1)).alias("q"))
    number = lambda v: v.cast("double")
    corners = F.array(*[F.array(number(x), number(y)) for x, y in ((F.lit(1.5), C("q")), (F.lit(8), F.lit(1)), (F.lit(8), C("k") % 50), (1 - C("q"), F.lit(8.9)))])
    shape = F.when(C("k") % 13 == 0, F.slice(corners, 1, 3)).when(C("k") % 17 == 0, F.transform(corners, lambda p: F.array(p[0], F.lit(float("nan"))))).otherwise(corners)
    first = notes.select("batch", text("m", C("k")).alias("annotation_id"), "image_id", corners.alias("boundary_corners"), F.lit(None).cast("string").alias("supersedes_annotation_id"))
    second = notes.select("batch", text("n", C("k")).alias("annotation_id"), "image_id", shape.alias("boundary_corners"), text("m", C("k")).alias("supersedes_annotation_id"))
    found = samples.confirmed_samples(entries, first.unionByName(second), objects)
    return found.select("image_id", "object_path", F.array_join(F.transform("boundary_corners", lambda p: F.array_join(p.cast("array<string>"), " ")), ",").alias("corners"), "annotation_id")
