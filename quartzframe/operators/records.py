"""Records of a run: revisions, feedback checks, provider outputs, seals, chosen candidates, run documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import filled
from .ranking import top_k

#: Phases of a confirmation, texts of a feedback event, hashes and texts of a seal, and how a batch folder is named.
PHASES = ("PREPARED", "ANNOTATION_COMMITTED", "FEEDBACK_COMMITTED", "ABORTED")
FEEDBACK_TEXTS = ("detection_id", "image_id", "source_hash", "orientation_transform", "algorithm_version", "mode")
SEAL_TEXTS = ("candidate_id", "git_commit", "analysis_version", "analysis_hash", "environment_fingerprint", "seal_timestamp")
SEAL_HASHES = ("public_manifest_hash", "frozen_attestation_hash", "split_hash", "final_benchmark_manifest_hash", "final_benchmark_result_hash")


def revise(previous: DataFrame, changes: DataFrame, id_column: str, changed: list[str], supersedes: str = "supersedes_annotation_id") -> DataFrame:
    """Events that supersede ``previous``: their columns, those of ``changes`` (by id) in place of the old ones, and the id they replace."""
    new = changes.select(id_column, *[F.col(c).alias(f"_new_{c}") for c in changed])
    kept = [c for c in previous.columns if c not in (id_column, supersedes, *changed)]
    return previous.join(new, id_column).select(*kept, *[F.col(f"_new_{c}").alias(c) for c in changed], F.col(id_column).alias(supersedes))


def feedback_rules(expected_id: Column) -> list[tuple[str, Column]]:
    """Rules of a feedback event; ``expected_id`` is the identity that its content gives."""
    c = F.col
    confirms = F.coalesce(c("event_type") == "confirmation", F.lit(False))
    true = lambda x: F.coalesce(x, F.lit(False))
    return [
        ("schema_version", true(c("schema_version") == 1)), ("event_type", true(c("event_type").isin("prediction", "confirmation"))), ("event_id", true(c("event_id") == expected_id)),
        *[(n, true(F.length(n) > 0)) for n in FEEDBACK_TEXTS],
        ("transaction_phase", ~confirms | true(c("transaction_phase").isin(*PHASES))), ("annotation_id", ~confirms | true(F.length("annotation_id") > 0)),
    ]


def provider_candidates(results: DataFrame, provider: str = "provider", status: str = "status", candidates: str = "candidates") -> tuple[DataFrame, DataFrame]:
    """Candidates of providers that succeeded, and those of others with the reason against them; a provider that claims to have
    none but lists some is refused too."""
    rows = results.withColumn("_bad", F.col(status).isNotNull() & (F.col(status) != "success"))
    each = rows.select(*[c for c in results.columns if c != candidates], "_bad", F.posexplode(candidates).alias("index", "candidate"))
    return each.where("not _bad").drop("_bad"), each.where("_bad").withColumn("reason", F.concat(F.lit("provider_status:"), F.col(status))).drop("_bad")


def support_rules(candidate: Column, prior: Column, seeds: Column, groups: Column, seed_ids: Column, group_ids: Column) -> list[tuple[str, Column]]:
    """Rules of a ranked candidate: a finite prior, and support counts that agree with the lists of ids where these are given."""
    count = lambda n: F.coalesce(n >= 1, F.lit(False))
    fits = lambda ids, n: ids.isNull() | F.coalesce(F.size(F.array_distinct(ids)) == n, F.lit(False))
    finite = F.coalesce(~F.isnan(prior) & (F.abs(prior) != float("inf")), F.lit(False))
    return [("candidate_id", filled(candidate)), ("prior_score", finite), ("seed_support_count", count(seeds)), ("seed_source_group_count", count(groups)), ("seed_candidate_ids", fits(seed_ids, seeds)), ("seed_source_groups", fits(group_ids, groups))]


def prior_or(value: Column, default: float = 0.5) -> Column:
    """An outside candidate's prior."""
    return F.coalesce(value, F.lit(default))


def seal_rules() -> list[tuple[str, Column]]:
    """Rules of a candidate seal: texts, hashes, and that the benchmark was passed."""
    hashes = [(n, F.coalesce(F.col(n).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))) for n in SEAL_HASHES]
    return [("schema_version", F.coalesce(F.col("schema_version") == 1, F.lit(False))), *[(n, filled(F.col(n))) for n in SEAL_TEXTS], *hashes, ("final_benchmark_pass_state", F.coalesce("final_benchmark_pass_state", F.lit(False)))]


def seal_mismatch(seals: DataFrame, benchmark: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Seals with ``mismatch``: the first field in which their benchmark differs; ``missing`` without a benchmark."""
    other = benchmark.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    first = F.coalesce(*[F.when(~F.col(f).eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields])
    return seals.join(other, key, "left").select(*seals.columns, F.when(F.col("_there").isNull(), "missing").otherwise(first).alias("mismatch"))


def chosen(rows: DataFrame, candidate: str, score: str, rank: str, corners: Column, width: Column, height: Column, preview_width: Column, preview_height: Column) -> DataFrame:
    """Rows with the columns of a chosen candidate: its corners, those of the preview (halves to even), its id, rank and score."""
    preview = F.transform(corners, lambda p: F.struct(F.rint(p["x"] * preview_width / width).cast("int").alias("x"), F.rint(p["y"] * preview_height / height).cast("int").alias("y")))
    return rows.select("*", corners.alias("boundary_corners"), preview.alias("preview_corners"), F.col(score).alias("overall_confidence"), F.col(candidate).cast("string").alias("chosen_id"), F.col(rank).cast("int").alias("chosen_rank"))


def ambiguous_primary(rows: DataFrame, by: list[str], candidate: str, score: str, corners: str, framed: str, gap: float = 0.08, apart: float = 0.18, least: float = 0.62) -> DataFrame:
    """Rows (by, ambiguous): whether the two best candidates of an image are about equally good, lie apart and neither is a frame (a missing flag is none)."""
    best = top_k(rows, by, [F.col(score).desc(), F.col(candidate)], 2, "_r")
    middle = lambda a: F.aggregate(F.col(corners), F.lit(0.0), lambda s, p: s + p[a]) / 4
    parts = best.select(*by, "_r", F.col(score).alias("_s"), F.coalesce(F.col(framed), F.lit(False)).alias("_f"), middle("x").alias("_x"), middle("y").alias("_y"), (F.array_max(F.transform(corners, lambda p: F.abs(p["x"]))) + 1).alias("_w"))
    at = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c))).alias(f"{c}{r}")
    pair = parts.groupBy(*by).agg(*[at(c, r) for c in ("_s", "_f", "_x", "_y", "_w") for r in (1, 2)])
    far = F.hypot(F.col("_x1") - F.col("_x2"), F.col("_y1") - F.col("_y2")) / F.greatest("_w1", "_w2")
    found = ~F.col("_f1") & ~F.col("_f2") & (F.abs(F.col("_s1") - F.col("_s2")) <= gap) & (far > apart) & (F.least("_s1", "_s2") >= least)
    return pair.select(*by, F.coalesce(found & F.col("_s2").isNotNull(), F.lit(False)).alias("ambiguous"))


def fallback_result(rows: DataFrame, reason: Column, cancelled: Column, provider_status: Column, detector: str = "v8") -> DataFrame:
    """Rows left as they are, with a status and an envelope that say why another detector's result stands."""
    envelope = F.struct(F.lit(detector).alias("requested_detector"), provider_status.alias("provider_status"), reason.alias("fallback_reason"))
    return rows.select("*", F.when(cancelled, "cancelled").otherwise("v7_fallback").alias("status"), envelope.alias("audit_envelope"))


def batch_folders(paths: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows whose last folder is a batch's: named by ``pattern`` and not hidden."""
    name = F.element_at(F.split(path, "/"), -1)
    return paths.select("*", name.alias("batch_id")).where(~name.startswith(".") & name.rlike(f"^(?:{pattern})$"))


def run_documents(spark: SparkSession, path: str, schema: str, finished: bool) -> DataFrame:
    """Run documents (one JSON object a file) that are finished, or still open; a file that is no such object raises."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    return rows.where(done if finished else ~done)


def restored(sources: DataFrame, results: DataFrame, key: str, same: list[str], info: str) -> DataFrame:
    """All sources with their stored results, null where none is stored; a result of another source, or a stored row without its result, raises."""
    other = results.select(key, F.lit(True).alias("_stored"), F.col(info), *[F.col(c).alias(f"_r_{c}") for c in same])
    fits = F.col(info).isNotNull()
    for c in same:
        fits = fits & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = F.when(F.col("_stored").isNull() | fits, F.col(info)).otherwise(F.raise_error(F.concat(F.lit("a stored result conflicts with source "), F.col(key).cast("string"))))
    return sources.join(other, key, "left").select(*sources.columns, checked.alias(info))
