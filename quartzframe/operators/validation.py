"""Record validation: rules as columns, the first broken one as a reason, and the derived fields that rules recompute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.identity import canonical_hash, is_blank, is_timestamp_with_offset, is_version, round_half_even

#: Field types of the two event logs.
CORNERS = "array<array<int>>"
ANNOTATION = (
    f"schema_version int, annotation_id string, image_id string, run_id string, algorithm_boundary_corners {CORNERS}, boundary_corners {CORNERS}, confirmation string, adjusted_corner_indices array<int>, "
    "corner_errors_px array<double>, confirmation_duration_ms long, confirmed_at string, supersedes_annotation_id string, gui_version string"
)
CROP = (
    f"schema_version int, event_id string, crop_id string, image_id string, annotation_id string, boundary_corners {CORNERS}, crop_corners array<array<double>>, inset struct<method:string,distance_px:double>, "
    "output_path string, status string, error string, created_at string"
)


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that doesn't hold; null counts as broken. Null for a valid row."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(name))
    return out


def split_valid(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reason."""
    marked = rows.withColumn("reason", first_broken(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def require(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The rows; reading one that breaks a rule raises."""
    reason = first_broken(rules)
    return rows.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), reason))))


def four_points(corners: Column) -> Column:
    return F.coalesce((F.size(corners) == 4) & F.forall(corners, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()), F.lit(False))


def changed_corners(before: Column, after: Column) -> Column:
    """Places (from 0) of corners that differ."""
    return F.array_compact(F.zip_with(F.transform(after, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), before, lambda a, b: F.when(a["p"] != b, a["i"])))


def corner_shift(before: Column, after: Column) -> Column:
    """Distance that each corner moved, not rounded."""
    return F.zip_with(before, after, lambda a, b: F.hypot((b[0] - a[0]).cast("double"), (b[1] - a[1]).cast("double")))


def annotation_rules() -> list[tuple[str, Column]]:
    """Rules of confirmed annotations; fields that follow from the corners must equal what follows."""
    c = F.col
    before, after = c("algorithm_boundary_corners"), c("boundary_corners")
    changed = changed_corners(before, after)
    errors = F.array(*[round_half_even(F.get(corner_shift(before, after), F.lit(i)), 3) for i in range(4)])
    return [
        ("schema_version", c("schema_version").isin(1, 2)),
        ("ids", ~is_blank(c("annotation_id")) & ~is_blank(c("image_id")) & ~is_blank(c("run_id"))),
        ("corners", four_points(before) & four_points(after)),
        ("adjusted_corner_indices", c("adjusted_corner_indices") == changed),
        ("confirmation", c("confirmation") == F.when(F.size(changed) > 0, "adjusted").otherwise("accepted")),
        ("corner_errors_px", c("corner_errors_px") == errors),
        ("confirmation_duration_ms", c("confirmation_duration_ms") >= 0),
        ("confirmed_at", is_timestamp_with_offset(c("confirmed_at"))),
        ("supersedes_annotation_id", c("supersedes_annotation_id").isNull() | ~is_blank(c("supersedes_annotation_id"))),
        ("gui_version", (c("schema_version") == 1) & c("gui_version").isNull() | (c("schema_version") == 2) & is_version(c("gui_version"))),
    ]


def build_annotations(rows: DataFrame) -> DataFrame:
    """Adds the derived fields to rows that have both corner columns."""
    before, after = F.col("algorithm_boundary_corners"), F.col("boundary_corners")
    made = rows.withColumn("adjusted_corner_indices", changed_corners(before, after))
    made = made.withColumn("confirmation", F.when(F.size("adjusted_corner_indices") > 0, "adjusted").otherwise("accepted"))
    return made.withColumn("corner_errors_px", F.array(*[round_half_even(F.get(corner_shift(before, after), F.lit(i)), 3) for i in range(4)]))


def crop_rules() -> list[tuple[str, Column]]:
    """Rules of crop events: a success names its output and no error, a failure its error and no output."""
    c = F.col
    done = (c("status") == "succeeded") & ~is_blank(c("output_path")) & c("error").isNull()
    failed = (c("status") == "failed") & c("output_path").isNull() & ~is_blank(c("error"))
    numbers = F.forall("crop_corners", lambda p: (F.size(p) == 2) & ~F.isnan(p[0]) & ~F.isnan(p[1]))
    return [
        ("schema_version", c("schema_version") == 1),
        ("ids", ~is_blank(c("event_id")) & ~is_blank(c("crop_id")) & ~is_blank(c("image_id")) & ~is_blank(c("annotation_id"))),
        ("corners", four_points(c("boundary_corners")) & (F.size("crop_corners") == 4) & numbers),
        ("inset", (c("inset.method") == "parallel_edge_offset") & (c("inset.distance_px") >= 0)),
        ("outcome", done | failed),
        ("created_at", is_timestamp_with_offset(c("created_at"))),
    ]


def event_identity(body: Column, identity: list[str], prefix: str) -> Column:
    """Deterministic id of a JSON body: a retry that differs in other fields collapses."""
    return F.concat(F.lit(prefix), canonical_hash(body, fields=identity, ascii_only=True))


def unreviewed(labels: Column) -> Column:
    """Whether a map of labels holds a mark of a pending review, in a key or a value."""
    marks = lambda x: F.lower(F.trim(x)).isin("unreviewed", "pending", "unknown")
    return F.coalesce(F.exists(F.map_keys(labels), marks) | F.exists(F.map_values(labels), marks), F.lit(False))


def manifest_rules(labels: str = "audited_labels", truth: str = "photo_truth") -> list[tuple[str, Column]]:
    """Rules of evaluation samples, truth being a quad."""
    return [
        ("ids", ~is_blank(F.col("image_id")) & ~is_blank(F.col("origin_group_id"))),
        ("split", F.col("split").isin("train", "validation", "frozen_test")),
        ("truth", g.is_complete(F.col(truth)) & g.is_convex(F.col(truth))),
        ("labels", ~unreviewed(F.col(labels))),
        ("auditor", ~is_blank(F.col("auditor"))),
    ]
