"""What space the corners of an annotation are in: decided by records, sealed with hashes, checked again, and mapped to the full picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.identity import canonical_hash, struct_hash
from ..functions.schemas import filled

#: The two spaces, the order of corners, kinds of evidence.
STORED, FULL = "stored_raster_original", "full_exif_normalized"
CORNER_ORDER = "full_normalized_tl_tr_br_bl"
IMPORTED, CONFIRMED, CLEAN_RUN = "reviewed_legacy_import_transform", "v7_normalized_confirmation_transaction", "clean_legacy_gui_normalized_raster"
FLAT = 1e-9
C = F.col


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), canonical_hash(text))


def _struct_hash(rows: DataFrame, value: Column, nulls: bool = True) -> Column:
    return F.concat(F.lit("sha256:"), struct_hash(rows, value, nulls))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that isn't true; null if all are."""
    return F.coalesce(*[F.when(~_true(ok), F.lit(name)) for name, ok in rules])


def required(value: Column, reason: Column) -> Column:
    """The value; raises where there is a reason against it."""
    return F.when(reason.isNull(), value).otherwise(F.raise_error(reason))


def decided(rows: DataFrame) -> DataFrame:
    """Rows with ``coordinate_space``, ``evidence`` (kind, identity) and ``reason``: one of space and reason is null.

    Columns: annotation_id, image_id, run_id, annotation_provenance (JSON object); ``run`` (run_id, batch_id, run_artifact_hash, git_available, git_dirty, git_commit, opencv);
    ``run_image`` (run_id, image_id, legacy_import, source_original_size, normalized_size, original_size, orientation_transform); ``rule`` (coordinate_space,
    batch_id, evidence_document_hash), null without one; ``loaded`` (see ``sealed``). Ids that disagree are refused. A rule decides alone: it applies or the row is
    refused. Else sizes and orientation of a confirmation do, else the size that a clean run recorded. Corners are never looked at.
    """
    run, image, rule, loaded = (C(x) for x in ("run", "run_image", "rule", "loaded"))
    ids = filled(C("annotation_id")) & filled(C("image_id")) & filled(C("run_id")) & (run["run_id"] == C("run_id")) & (F.coalesce(image["run_id"], run["run_id"]) == C("run_id")) & (image["image_id"] == C("image_id"))
    ruled = C("annotation_provenance").isNotNull() & image["legacy_import"] & (rule["coordinate_space"] == STORED) & rule["batch_id"].eqNullSafe(run["batch_id"]) & rule["evidence_document_hash"].startswith("sha256:")
    confirmed = (image["source_original_size"] == loaded["original_size"]) & (image["normalized_size"] == loaded["full_normalized_size"]) & (image["orientation_transform"] == loaded["orientation_transform"])
    clean = (image["original_size"] == loaded["full_normalized_size"]) & run["git_available"] & ~run["git_dirty"] & (F.length(run["git_commit"]) > 0) & (F.length(run["opencv"]) > 0)
    kind = F.when(~_true(ids), None).when(rule.isNotNull(), F.when(_true(ruled), IMPORTED)).when(_true(confirmed), CONFIRMED).when(_true(clean), CLEAN_RUN)
    reason = F.when(~_true(ids), "identity").when(rule.isNotNull() & ~_true(ruled), "stored_rule").when(C("_kind").isNull(), "ambiguous")
    base = [C("annotation_id"), run["batch_id"].alias("batch_id"), C("run_id"), run["run_artifact_hash"].alias("run_artifact_hash")]
    parts = {
        IMPORTED: [rule["evidence_document_hash"].alias("evidence_document_hash")],
        CONFIRMED: [image[x].alias(x) for x in ("source_original_size", "normalized_size", "orientation_transform")],
        CLEAN_RUN: [image["original_size"].alias("recorded_gui_size"), loaded["full_normalized_size"].alias("full_normalized_size"), run["git_commit"].alias("git_commit"), run["opencv"].alias("opencv")],
    }
    text = {k: _json(*base, *more) for k, more in parts.items()}
    text[IMPORTED] = F.concat(F.lit('{"annotation_provenance":'), C("annotation_provenance"), F.lit(","), F.substring(text[IMPORTED], 2, 1 << 30))
    chosen = F.coalesce(*[F.when(C("_kind") == k, t) for k, t in text.items()])
    known = rows.withColumn("_kind", kind).withColumn("_identity", _hash(chosen))
    return known.select(
        *rows.columns, F.when(C("_kind") == IMPORTED, STORED).when(C("_kind").isNotNull(), FULL).alias("coordinate_space"),
        F.when(C("_kind").isNotNull(), F.struct(C("_identity").alias("identity"), C("_kind").alias("kind"))).alias("evidence"), reason.alias("reason"),
    )


def _source(loaded: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.regexp_replace(loaded["source_sha256"], "^sha256:", ""))


def _transform_text(loaded: Column) -> Column:
    names = ("exif_orientation", "original_size", "full_normalized_size", "analysis_size", "forward_transform", "inverse_transform", "analysis_to_full_transform")
    return _json(_source(loaded).alias("source_sha256"), *[loaded[n].alias(n) for n in names])


SEALED = ("exif_orientation", "original_size", "full_normalized_size", "analysis_size")


def sealed(rows: DataFrame) -> DataFrame:
    """Rows with ``provenance``, null where ids, corners, the space or the evidence are missing.

    ``loaded`` has source_sha256, exif_orientation, original_size, full_normalized_size, analysis_size and the three transforms
    forward, inverse and analysis_to_full, 3 x 3 each.
    """
    loaded, evidence = C("loaded"), C("evidence")
    good = filled(C("annotation_id")) & filled(C("image_id")) & g.is_complete(C("boundary_corners")) & C("coordinate_space").isin(STORED, FULL) & filled(evidence["kind"]) & filled(evidence["identity"])
    hashed = rows.withColumn("_evidence", _struct_hash(rows, evidence, nulls=False)).withColumn("_transform", _hash(_transform_text(loaded)))
    named = {
        "schema_version": F.lit(1), **{n: C(n) for n in ("annotation_id", "image_id", "coordinate_space")}, "corner_order": F.lit(CORNER_ORDER), "evidence": evidence, "evidence_hash": C("_evidence"),
        "source_sha256": _source(loaded), **{n: loaded[n] for n in SEALED}, "transform_hash": C("_transform"),
    }
    fields = [v.alias(n) for n, v in sorted(named.items())]  # in the order that they are hashed in
    whole = hashed.withColumn("_id", _struct_hash(hashed, F.struct(*fields)))
    return whole.select(*rows.columns, F.when(_true(good), F.struct(*fields, C("_id").alias("provenance_id"))).alias("provenance"))


def resolved(rows: DataFrame) -> DataFrame:
    """Rows with ``truth``, the corners in the full picture, and ``refused``, the first reason against them; one of both is null.

    Every hash of ``provenance`` is computed again from what it covers, and the transforms from ``loaded``.
    """
    p, loaded, q = C("provenance"), C("loaded"), C("boundary_corners")
    own = rows.withColumn("_id", _struct_hash(rows, p.dropFields("provenance_id"))).withColumn("_evidence", _struct_hash(rows, p["evidence"], nulls=False)).withColumn("_transform", _hash(_transform_text(loaded)))
    same = p["source_sha256"].eqNullSafe(_source(loaded)) & (p["transform_hash"] == C("_transform"))
    for n in SEALED:
        same = same & p[n].eqNullSafe(loaded[n])
    lifted = g.homography(g.homography(q, loaded["forward_transform"]), loaded["analysis_to_full_transform"])
    own = own.withColumn("_truth", F.when(p["coordinate_space"] == STORED, lifted).otherwise(q))
    turns, size = g.turns(C("_truth")), loaded["full_normalized_size"]
    reason = first_reason([
        ("missing", p.isNotNull()), ("schema", p["schema_version"] == 1), ("hash", p["provenance_id"] == C("_id")),
        ("annotation", (p["annotation_id"] == C("annotation_id")) & (p["image_id"] == C("image_id"))), ("semantics", p["coordinate_space"].isin(STORED, FULL) & (p["corner_order"] == CORNER_ORDER)),
        ("evidence", p["evidence_hash"] == C("_evidence")), ("transform", same), ("corners", g.is_complete(q)), ("point", C("_truth").isNotNull()),
        ("bounds", g.in_bounds(C("_truth"), size[0], size[1])), ("convex", F.forall(turns, lambda t: t > FLAT) | F.forall(turns, lambda t: t < -FLAT)),
    ])
    return own.withColumn("refused", reason).select(*rows.columns, F.when(C("refused").isNull(), C("_truth")).alias("truth"), "refused")
