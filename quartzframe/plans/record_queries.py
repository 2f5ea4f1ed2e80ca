"""Registered queries of records and their checks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import identity as ident
from ..functions import schemas as sc
from ..operators import records as rec
from ..operators.validation import first_broken
from .queries import QUAD_SQL, _quads, register, table

C = F.col


@register("identity_check", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'request_id' WHEN c_custkey % 7 = 0 THEN 'parameter_sha256' WHEN c_custkey % 11 = 0 THEN 'mode' END AS reason FROM customer")
def identity_check(spark: SparkSession, d: str) -> DataFrame:
    k = C("c_custkey")
    values = {"request_id": F.when(k % 5 == 0, " ").otherwise(C("c_name")), "image_id": C("c_name"), "orientation_transform": F.lit("1"), "algorithm_version": F.lit("8.4"), "parameter_sha256": F.when(k % 7 == 0, "abc").otherwise(F.sha2(C("c_name"), 256)), "mode": F.when(k % 11 == 0, F.lit(None)).otherwise(F.when(k % 2 == 0, "safe").otherwise("aggressive"))}
    made = F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in sc.IDENTITY.fields])
    return table(spark, d, "customer").select("c_custkey", made.alias("i")).select("c_custkey", first_broken(sc.identity_rules(C("i"))).alias("reason"))


@register("audit_check", "SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'candidate_id' WHEN vec_id % 4 = 1 THEN 'sources' WHEN vec_id % 10 = 3 THEN 'adopted_refined_corners' END AS reason FROM embeddings")
def audit_check(spark: SparkSession, d: str) -> DataFrame:
    corners = F.transform(C("q"), lambda p: F.array(p["x"], p["y"]))
    values = {"candidate_id": F.when(C("vec_id") % 6 != 0, C("vec_id").cast("string")), "sources": F.array(F.lit("a"), F.when(C("vec_id") % 4 == 1, "").otherwise("b")), "original_legal_corners": corners, "adopted_refined_corners": F.when(C("vec_id") % 10 == 3, F.slice(corners, 1, 3))}
    made = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sc.AUDIT.fields])
    return _quads(spark, d).select("vec_id", made.alias("a")).select("vec_id", first_broken(sc.audit_rules(C("a"))).alias("reason"))


@register("result_check", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'status' WHEN l_discount * 12 > 1 THEN 'overall_confidence' WHEN l_quantity / 40 > 1 THEN 'edge_confidences' END AS reason FROM lineitem")
def result_check(spark: SparkSession, d: str) -> DataFrame:
    values = {"status": F.when(C("l_partkey") % 9 == 0, "odd").otherwise("ok"), "overall_confidence": C("l_discount") * 12, "edge_confidences": F.array(C("l_tax"), C("l_quantity") / 40)}
    made = F.struct(*[values[n].cast(sc.RESULT[n].dataType).alias(n) if n in values else F.lit(None).cast(sc.RESULT[n].dataType).alias(n) for n in ("status", "overall_confidence", "edge_confidences", "corner_confidences")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", made.alias("r")).select("l_orderkey", "l_linenumber", first_broken(sc.result_rules(C("r"), ("ok", "no_photo"))).alias("reason"))


@register("feedback_check", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'schema_version' WHEN event_type NOT IN ('click', 'purchase') THEN 'event_type' WHEN event_id % 7 = 0 THEN 'event_id' WHEN event_id % 5 = 0 THEN 'source_hash' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'transaction_phase' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'annotation_id' END AS reason FROM events")
def feedback_check(spark: SparkSession, d: str) -> DataFrame:
    k, kind = C("event_id"), F.when(C("event_type") == "click", "prediction").when(C("event_type") == "purchase", "confirmation").otherwise(C("event_type"))
    identity = F.sha2(C("props"), 256)
    rows = table(spark, d, "events").select(
        k.alias("key"), F.when(k % 13 == 0, 2).otherwise(1).alias("schema_version"), kind.alias("event_type"), F.when(k % 7 == 0, "x").otherwise(identity).alias("event_id"), identity.alias("want"),
        *[F.when((k % 5 == 0) & F.lit(n == "source_hash"), "").otherwise("v").alias(n) for n in rec.FEEDBACK_TEXTS], F.when(k % 3 == 0, "OPEN").otherwise("PREPARED").alias("transaction_phase"), F.when(k % 4 != 0, "a").alias("annotation_id"),
    )
    return rows.select(C("key").alias("event_id"), first_broken(rec.feedback_rules(C("want"))).alias("reason"))


@register("revised_events", "SELECT e.user_id AS image_id, e.props AS body, f.value AS corners, e.event_id AS supersedes FROM events e JOIN (SELECT event_id - 1 AS event_id, value FROM events WHERE event_id % 4 = 0) f USING (event_id)")
def revised_events(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    old = events.select(C("event_id").alias("id"), C("user_id").alias("image_id"), C("props").alias("body"), C("value").alias("corners"), F.lit(None).cast("long").alias("supersedes"))
    new = events.where("event_id % 4 = 0").select((C("event_id") - 1).alias("id"), C("value").alias("corners"))
    return rec.revise(old, new, "id", ["corners"], "supersedes")


@register("provider_rejects", "SELECT l_orderkey, l_linenumber, i AS index, CASE WHEN l_partkey % 4 = 0 THEN 'provider_status:error' WHEN l_partkey % 4 = 1 THEN 'provider_status:no_candidate' END AS reason FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(range(0, l_suppkey % 3))::INTEGER AS i FROM lineitem)")
def provider_rejects(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(C("l_partkey") % 4 == 0, "error").when(C("l_partkey") % 4 == 1, "no_candidate").when(C("l_partkey") % 4 == 2, "success")
    listed = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (C("l_suppkey") % 3).cast("int"))
    good, bad = rec.provider_candidates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"), listed.alias("candidates")))
    return good.select("l_orderkey", "l_linenumber", "index", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("l_orderkey", "l_linenumber", "index", "reason"))


@register("support_check", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN 'prior_score' WHEN l_suppkey % 4 = 0 THEN 'seed_support_count' WHEN l_partkey % 2 = 0 AND l_suppkey % 4 <> 2 THEN 'seed_candidate_ids' END AS reason, CASE WHEN l_partkey % 3 = 0 THEN 0.5 ELSE l_discount END AS prior FROM lineitem")
def support_check(spark: SparkSession, d: str) -> DataFrame:
    prior = F.when(C("l_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(C("l_discount"))
    ids = F.when(C("l_partkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("x")))
    rules = rec.support_rules(F.lit("c"), prior, C("l_suppkey") % 4, F.lit(1), ids, F.lit(None).cast("array<string>"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", first_broken(rules).alias("reason"), rec.prior_or(F.when(C("l_partkey") % 3 != 0, C("l_discount"))).alias("prior"))


@register("seal_check", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'schema_version' WHEN p_partkey % 7 = 0 THEN 'git_commit' WHEN p_partkey % 5 = 0 THEN 'split_hash' WHEN p_size % 4 = 0 THEN 'final_benchmark_pass_state' END AS reason FROM part")
def seal_check(spark: SparkSession, d: str) -> DataFrame:
    k, good = C("p_partkey"), F.concat(F.lit("sha256:"), F.sha2(C("p_name"), 256))
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 9 == 0, 2).otherwise(1).alias("schema_version"), *[F.when((k % 7 == 0) & F.lit(n == "git_commit"), " ").otherwise("v").alias(n) for n in rec.SEAL_TEXTS],
        *[F.when((k % 5 == 0) & F.lit(n == "split_hash"), "sha256:1").otherwise(good).alias(n) for n in rec.SEAL_HASHES], (C("p_size") % 4 != 0).alias("final_benchmark_pass_state"),
    )
    return rows.select("p_partkey", first_broken(rec.seal_rules()).alias("reason"))


@register("seal_benchmark", "SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END AS mismatch FROM part a LEFT JOIN (SELECT p_partkey - 1 AS p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 <> 0) b USING (p_partkey)")
def seal_benchmark(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    other = part.where("p_partkey % 10 <> 0").select((C("p_partkey") - 1).alias("p_partkey"), "p_brand", "p_size")
    return rec.seal_mismatch(part.select("p_partkey", "p_brand", "p_size"), other, "p_partkey", ["p_brand", "p_size"]).select("p_partkey", "mismatch")


@register("chosen_candidate", "SELECT vec_id, " + ", ".join(f"round_even(p{a}{i} * {p}::DOUBLE / {s}::DOUBLE, 0)::INTEGER AS {a}{i}" for a, p, s in (("x", 320, 1000), ("y", 240, 800)) for i in range(4)) + f", label * 0.1::DOUBLE AS overall_confidence, vec_id::VARCHAR AS chosen_id, (label + 1)::INTEGER AS chosen_rank FROM {QUAD_SQL}")
def chosen_candidate(spark: SparkSession, d: str) -> DataFrame:
    rows = _quads(spark, d).withColumn("score", C("label") * F.lit(0.1)).withColumn("rank", C("label") + 1)
    out = rec.chosen(rows, "vec_id", "score", "rank", C("q"), F.lit(1000.0), F.lit(800.0), F.lit(320.0), F.lit(240.0))
    return out.select("vec_id", *[F.get("preview_corners", F.lit(i))[a].alias(f"{a}{i}") for a in "xy" for i in range(4)], "overall_confidence", "chosen_id", "chosen_rank")


@register("ambiguous_primary", """WITH x AS (SELECT l_orderkey, l_linenumber, 0.6::DOUBLE + l_discount * 0.97::DOUBLE AS s, l_partkey % 6 = 0 AS f, (l_partkey % 500)::DOUBLE AS x, l_linenumber * 40.0::DOUBLE AS y, l_partkey * 1000000 + l_suppkey * 100 + l_quantity AS id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, id) AS r FROM x)
    SELECT a.l_orderkey, coalesce(NOT a.f AND NOT b.f AND abs(a.s - b.s) <= 0.08 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / greatest(a.x + 51, b.x + 51) > 0.18 AND least(a.s, b.s) >= 0.62, false) AS ambiguous FROM r a LEFT JOIN r b ON b.l_orderkey = a.l_orderkey AND b.r = 2 WHERE a.r = 1""")
def ambiguous_primary(spark: SparkSession, d: str) -> DataFrame:
    x, y = (C("l_partkey") % 500).cast("double"), C("l_linenumber") * 40.0
    rows = table(spark, d, "lineitem").select("l_orderkey", (C("l_partkey") * 1000000 + C("l_suppkey") * 100 + C("l_quantity")).alias("id"), (C("l_discount") * 0.97 + 0.6).alias("s"), (C("l_partkey") % 6 == 0).alias("f"), g.quad(x - 50, y - 30, x + 50, y - 30, x + 50, y + 30, x - 50, y + 30).alias("q"))
    return rec.ambiguous_primary(rows, ["l_orderkey"], "id", "s", "q", "f")


@register("fallback_results", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'v7_fallback' END AS status, 'v8|' || o_orderstatus || '|' || o_orderpriority AS envelope FROM orders")
def fallback_results(spark: SparkSession, d: str) -> DataFrame:
    rows = rec.fallback_result(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), C("o_orderpriority"), C("o_orderstatus") == "P", C("o_orderstatus"))
    return rows.select("o_orderkey", "status", F.concat_ws("|", "audit_envelope.requested_detector", "audit_envelope.provider_status", "audit_envelope.fallback_reason").alias("envelope"))


@register("batch_folders", "SELECT p_partkey, 'batch_' || p_size AS batch_id FROM part WHERE p_partkey % 3 = 0")
def batch_folders(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(C("p_partkey") % 3 == 0, F.concat(F.lit("batch_"), "p_size")).when(C("p_partkey") % 3 == 1, F.concat(F.lit(".batch_"), "p_size")).otherwise("notes")
    return rec.batch_folders(table(spark, d, "part").select("p_partkey", F.concat(F.lit("/data/batches/"), name).alias("path")), "path", "batch_[0-9]+").select("p_partkey", "batch_id")


@register("restored_results", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS info FROM customer")
def restored_results(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    stored = rows.where("c_custkey % 4 <> 0").select("c_custkey", "c_name", C("c_mktsegment").alias("info"))
    return rec.restored(rows.select("c_custkey", "c_name"), stored, "c_custkey", ["c_name"], "info")


_POINTS = "'[[' || (l_partkey % 90)::DOUBLE || ',' || (l_suppkey % 40 + 0.5::DOUBLE) || '],[' || l_quantity::DOUBLE || ',' || l_linenumber::DOUBLE || ']]'"


@register("corner_ids", f"SELECT l_orderkey, l_linenumber, substr(sha256({_POINTS}), 1, 20) AS plain, substr(sha256('[\"line\",\"' || l_returnflag || '\",null,' || {_POINTS} || ']'), 1, 20) AS named FROM lineitem")
def corner_ids(spark: SparkSession, d: str) -> DataFrame:
    corners = F.array(g.point((C("l_partkey") % 90).cast("double"), C("l_suppkey") % 40 + F.lit(0.5)), g.point(C("l_quantity").cast("double"), C("l_linenumber").cast("double")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ident.corner_id(corners).alias("plain"), ident.corner_id(corners, F.lit("line"), C("l_returnflag"), F.lit(None).cast("string")).alias("named"))


@register("source_keys", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand || ':' || p_partkey END AS key, 'Viewer 1.0 · Algorithm ' || CASE WHEN p_size % 3 = 0 THEN p_size || '.1' ELSE 'unknown' END AS title FROM part")
def source_keys(spark: SparkSession, d: str) -> DataFrame:
    key = ident.source_key(F.when(C("p_partkey") % 5 != 0, C("p_brand")).otherwise(""), C("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", key.alias("key"), ident.titled("Viewer", "1.0", F.when(C("p_size") % 3 == 0, F.concat("p_size", F.lit(".1"))).otherwise(C("p_name"))).alias("title"))
