"""Registered queries over the driver tables, each with the SQL that gives the same rows.

The tables aren't photo data: each query binds an operator to the table whose shape fits it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import identity as ident
from ..functions import lines as ln
from ..functions import stats as st
from ..operators import decisions as dec
from ..operators import evaluation as ev
from ..operators import logs, ranking, sequences, splits, validation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT_SQL = "CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'frozen_test' END"
BUCKET_SQL = "(('0x' || substr(sha256('1:quartz:' || doc_id::VARCHAR), 1, 16))::UBIGINT % 100)::INTEGER"


@register(
    "confirmed_split_rate",
    f"""WITH s AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b, {SPLIT_SQL} AS split FROM (SELECT d.doc_id, quality, toxic, {BUCKET_SQL.replace("doc_id", "d.doc_id")} AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id)),
    c AS (SELECT split, count(*) AS n, count(*) FILTER (a) AS x, count(*) FILTER (b) AS y, count(*) FILTER (a AND NOT b) AS improved, count(*) FILTER (b AND NOT a) AS worsened FROM s GROUP BY 1),
    e AS (SELECT *, x::DOUBLE / n - y::DOUBLE / n AS estimate FROM c)
    SELECT split, n, improved, worsened, estimate, estimate - 1.96::DOUBLE * sqrt((improved + worsened)::DOUBLE / (n * n)::DOUBLE) AS ci_lower, estimate - 1.96::DOUBLE * sqrt((improved + worsened)::DOUBLE / (n * n)::DOUBLE) > 0 AS passed FROM e""",
)
def confirmed_split_rate(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed samples, split by hash, and the paired rate of each split."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    rows = splits.stable_split(rows, "doc_id", "quartz", "1")
    return ev.paired_rate(rows, F.col("quality") == 1, F.col("toxic") == 1, ["split"])


@register("latest_by_key", "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest_by_key(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@register("chain_position", "SELECT conv_id, turn, role, row_number() OVER w AS position, coalesce(lag(turn) OVER w, -1) AS previous_id, lead(turn) OVER w IS NULL AS is_head FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def chain_position(spark: SparkSession, d: str) -> DataFrame:
    return logs.chain_position(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "turn").withColumn("previous_id", F.coalesce("previous_id", F.lit(-1)))


CHAIN_SQL = "(SELECT event_id AS id, user_id AS k, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN event_id - 3 WHEN event_id % 11 = 0 THEN event_id + 1000000 END AS target FROM events)"


@register(
    "chain_violations",
    f"""WITH e AS {CHAIN_SQL}, p AS (SELECT e.id, CASE WHEN t.id IS NULL THEN 'unknown_target' WHEN t.k <> e.k THEN 'cross_key_target' WHEN t.pos >= e.pos THEN 'later_target' END AS violation FROM e LEFT JOIN e t ON e.target = t.id WHERE e.target IS NOT NULL),
    h AS (SELECT * FROM e WHERE id NOT IN (SELECT target FROM e WHERE target IS NOT NULL))
    SELECT id::VARCHAR AS id, violation FROM p WHERE violation IS NOT NULL
    UNION ALL SELECT id::VARCHAR, 'duplicate_id' FROM e GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT target::VARCHAR, 'branch' FROM e WHERE target IS NOT NULL GROUP BY target HAVING count(*) > 1
    UNION ALL SELECT k::VARCHAR, 'several_heads' FROM h GROUP BY k HAVING count(*) > 1""",
)
def chain_violations(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("event_id") % 7 == 0, F.col("event_id") - 3).when(F.col("event_id") % 11 == 0, F.col("event_id") + 1000000)
    log = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("k"), F.col("event_id").alias("pos"), target.cast("string").alias("target"))
    return logs.chain_violations(log, "id", "target", "k", "pos")


@register("active_heads", f"WITH e AS {CHAIN_SQL} SELECT id, k, pos FROM e WHERE id NOT IN (SELECT target FROM e WHERE target IS NOT NULL)")
def active_heads(spark: SparkSession, d: str) -> DataFrame:
    target = F.when(F.col("event_id") % 7 == 0, F.col("event_id") - 3).when(F.col("event_id") % 11 == 0, F.col("event_id") + 1000000)
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), F.col("event_id").alias("pos"), target.alias("target"))
    return logs.active_heads(log, "id", "target").select("id", "k", "pos")


@register("event_dedup", "SELECT user_id, event_type, day, min(event_id) AS event_id FROM (SELECT *, CAST(ts AS DATE)::VARCHAR AS day FROM events) GROUP BY 1, 2, 3")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "event_id")
    return logs.dedup_by(rows, ["user_id", "event_type", "day"], ["event_id"])


@register("idempotent_append", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    stored = e.where("event_id % 3 = 0")
    fresh, _ = logs.append_new(stored, e.where("event_id % 5 = 0"), "event_id", ["user_id", "event_type"])
    return stored.unionByName(fresh)


@register("append_conflicts", """WITH i AS (SELECT DISTINCT user_id AS id, event_type AS body FROM events WHERE event_id % 200 < 3), s AS (SELECT user_id AS id, min(event_type) AS body FROM events WHERE event_id % 50 = 7 GROUP BY 1), t AS (SELECT id FROM i GROUP BY 1 HAVING count(*) > 1)
    SELECT id, body, CASE WHEN id IN (SELECT id FROM t) OR EXISTS (SELECT 1 FROM s WHERE s.id = i.id AND s.body <> i.body) THEN 'conflict' ELSE 'new' END AS kind FROM i WHERE id IN (SELECT id FROM t) OR NOT EXISTS (SELECT 1 FROM s WHERE s.id = i.id AND s.body = i.body)""")
def append_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A batch against a log: ids of several payloads in the batch, or stored with another one, are conflicts."""
    e = table(spark, d, "events")
    stored = e.where("event_id % 50 = 7").groupBy(F.col("user_id").alias("id")).agg(F.min("event_type").alias("body"))
    fresh, clash = logs.append_new(stored, e.where("event_id % 200 < 3").select(F.col("user_id").alias("id"), F.col("event_type").alias("body")), "id", ["body"])
    return fresh.withColumn("kind", F.lit("new")).unionByName(clash.withColumn("kind", F.lit("conflict")))


@register("content_dedup", "SELECT 'sha256:' || sha256(text) AS object_id, count(*) AS copies, min(doc_id) AS first_doc, substr(sha256(text), 1, 2) AS prefix FROM documents WHERE text IS NOT NULL GROUP BY text")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("sha256:"), key).alias("object_id"), "doc_id")
    return rows.groupBy("object_id").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).withColumn("prefix", F.substring("object_id", 8, 2))


@register("preflight_bytes", "SELECT count(*) AS new_objects, coalesce(sum(n), 0)::BIGINT AS new_bytes FROM (SELECT text, max(n_chars) AS n FROM documents GROUP BY text HAVING text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0))")
def preflight_bytes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("key"), "n_chars", "doc_id")
    return logs.storage_preflight(docs, docs.where("doc_id % 10 = 0").select("key").distinct(), "key", "n_chars")


@register("confirmed_samples", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.n_chars > 0")
def confirmed_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@register("reconcile_left", "SELECT c_custkey, c_mktsegment, coalesce(o.o_orderstatus, 'none') AS status FROM customer c LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderstatus FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def reconcile_left(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit("none").alias("status"))
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return logs.reconcile(current, log, "c_custkey", ["o_orderdate", "o_orderkey"], {"status": "o_orderstatus"})


@register("route_anti_semi", "SELECT o_orderkey, o_custkey, 'base' AS store FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT o_orderkey, o_custkey, 'routed' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def route_anti_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    routes = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return logs.routed_union(orders.withColumn("store", F.lit("base")), orders.withColumn("store", F.lit("routed")), routes, "o_custkey").select("o_orderkey", "o_custkey", "store")


@register("transaction_recovery", "SELECT user_id, CASE n WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'purchase' END AS phase, CASE WHEN n >= 3 THEN 'none' WHEN n >= 2 THEN 'complete' ELSE 'abort' END AS recovery FROM (SELECT user_id, max(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END) AS n FROM events GROUP BY 1)")
def transaction_recovery(spark: SparkSession, d: str) -> DataFrame:
    return logs.transaction_state(table(spark, d, "events").select("user_id", "event_type"), "user_id", "event_type", ["click", "view", "purchase"])


@register("collapse_sources", "SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY 1")
def collapse_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.collapse_sources(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), "l_partkey", ["l_suppkey"], ["l_returnflag"])
    return rows.select("l_partkey", F.size("sources").cast("long").alias("sources"), "conflict")


@register("unique_match", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) = 1) ON o_custkey = c_custkey")
def unique_match(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return logs.unique_match(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"]).withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))


@register("stable_split", f"SELECT doc_id, {SPLIT_SQL} AS split FROM (SELECT doc_id, {BUCKET_SQL} AS b FROM documents)")
def stable_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.stable_split(table(spark, d, "documents").select("doc_id"), "doc_id", "quartz", "1")


@register("extend_split", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'train' ELSE {SPLIT_SQL} END AS split FROM (SELECT doc_id, {BUCKET_SQL} AS b FROM documents)")
def extend_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return splits.extend_split(docs.where("doc_id % 4 = 0").withColumn("split", F.lit("train")), docs, "doc_id", "quartz", "1")


@register("fraction_split", "SELECT doc_id, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE < 0.2::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM documents")
def fraction_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.fraction_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


GROUP_SQL = "(SELECT source, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.2, 0)::INTEGER)) THEN 'calibration' ELSE 'fit' END AS subset FROM (SELECT source, row_number() OVER (ORDER BY sha256('7:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)))"


@register("group_split_rank", f"SELECT * FROM {GROUP_SQL}")
def group_split_rank(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_split(table(spark, d, "documents"), "source", 7, 0.2)


@register(
    "lineage_explode",
    f"""WITH s AS {GROUP_SQL}, k AS (SELECT source, 'real' AS kind, -1 AS copy FROM s UNION ALL SELECT source, 'synthetic', unnest(range(0, 3))::INTEGER FROM s WHERE subset = 'fit')
    SELECT source, kind, copy, substr(sha256('7:' || source || ':' || kind || ':' || copy::VARCHAR), 1, 24) AS lineage_id, ('0x' || substr(sha256('7:' || source || ':' || kind || ':' || copy::VARCHAR), 25, 8))::BIGINT AS draw_seed FROM k""",
)
def lineage_explode(spark: SparkSession, d: str) -> DataFrame:
    return splits.lineage(splits.group_split(table(spark, d, "documents"), "source", 7, 0.2), "source", "subset", 3, 7)


@register("same_members", "SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def same_members(spark: SparkSession, d: str) -> DataFrame:
    return splits.same_members(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@register("attestation", "SELECT lang AS slice, count(*) AS samples, count(DISTINCT source) AS groups FROM documents GROUP BY 1 UNION ALL SELECT NULL, count(*), count(DISTINCT source) FROM documents")
def attestation(spark: SparkSession, d: str) -> DataFrame:
    return splits.attestation(table(spark, d, "documents").select("source", F.array("lang").alias("slices")), "source", "slices")


BUDGET_SQL = """(SELECT CASE WHEN user_id % 2 = 0 THEN 'fit' ELSE 'calibration' END AS subset, max(value) > 150 AS a, min(CASE WHEN value > 120 THEN r END) AS r, bool_or(event_type = 'purchase' AND value > 100) AS c
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY user_id)"""
COUNT_SQL = """count(*) AS samples, count(*) FILTER (a) AS base, count(*) FILTER (r IS NOT NULL) AS ranked, count(*) FILTER (c) AS other, count(*) FILTER (a OR r IS NOT NULL OR c) AS "any",
 count(*) FILTER (r IS NOT NULL AND NOT a) AS ranked_only, count(*) FILTER (c AND NOT a AND r IS NULL) AS other_only, count(*) FILTER (a OR c OR coalesce(r <= 1, false)) AS within_1,
 count(*) FILTER (a OR c OR coalesce(r <= 8, false)) AS within_8, count(*) FILTER (a OR c OR coalesce(r <= 64, false)) AS within_64"""
ALL_COUNTS_SQL = f"(SELECT 'all' AS subset, {COUNT_SQL} FROM {BUDGET_SQL} UNION ALL SELECT subset, {COUNT_SQL} FROM {BUDGET_SQL} GROUP BY subset)"


def _budget_rows(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    by = ranked.groupBy("user_id").agg((F.max("value") > 150).alias("a"), F.min(F.when(F.col("value") > 120, F.col("r"))).alias("r"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("c"))
    return by.withColumn("subset", F.when(F.col("user_id") % 2 == 0, "fit").otherwise("calibration"))


@register("budget_counts", f"""SELECT *, "any" - base AS gain, "any"::DOUBLE / samples AS rate FROM {ALL_COUNTS_SQL}""")
def budget_counts(spark: SparkSession, d: str) -> DataFrame:
    return ev.budget_counts(_budget_rows(spark, d), "a", "r", "c", "subset", (1, 8, 64))


@register(
    "feasibility_gate",
    f"""WITH x AS {ALL_COUNTS_SQL}, f AS (SELECT samples AS n, "any" AS u, "any" - base AS g FROM x WHERE subset = 'all'), c AS (SELECT samples AS cn, "any" AS cu, "any" - base AS cg FROM x WHERE subset = 'calibration'),
    t AS (SELECT *, ceil(n * 0.95::DOUBLE)::BIGINT AS need, ceil(cn * 0.95::DOUBLE)::BIGINT AS cneed FROM f, c),
    l AS (SELECT need, list_filter([CASE WHEN NOT u >= need THEN 'union_rate' END, CASE WHEN NOT g >= 30 THEN 'net_gain' END, CASE WHEN NOT cu >= cneed THEN 'calibration_union_rate' END, CASE WHEN NOT cg > 0 THEN 'calibration_net_gain' END], lambda z: z IS NOT NULL) AS fl FROM t)
    SELECT need AS needed_union, len(fl) = 0 AS passed, array_to_string(fl, ',') AS failed FROM l""",
)
def feasibility_gate(spark: SparkSession, d: str) -> DataFrame:
    return ev.feasibility_gate(ev.budget_counts(_budget_rows(spark, d), "a", "r", "c", "subset", (1, 8, 64)))


TERMINAL_SQL = "(SELECT CASE o_orderstatus WHEN 'F' THEN 'automatic' WHEN 'O' THEN 'manual_review' ELSE 'v7_fallback' END AS status, o_totalprice > 100000 AS s, o_totalprice < 1000 AS k FROM orders)"
SUMMARY_SQL = f"(SELECT count(*) AS samples, count(*) FILTER (status <> 'manual_review') AS automatic, count(*) FILTER (status <> 'manual_review' AND s) AS strict, count(*) FILTER (status <> 'manual_review' AND k) AS catastrophic, count(*) FILTER (status = 'manual_review') AS manual, count(*) FILTER (status = 'v7_fallback') AS fallback FROM {TERMINAL_SQL})"


def _terminal_rows(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "automatic").when(F.col("o_orderstatus") == "O", "manual_review").otherwise("v7_fallback")
    return table(spark, d, "orders").select(status.alias("status"), (F.col("o_totalprice") > 100000).alias("s"), (F.col("o_totalprice") < 1000).alias("k"))


@register("end_to_end_status", f"SELECT *, strict::DOUBLE / samples AS strict_rate, manual::DOUBLE / samples AS manual_rate FROM {SUMMARY_SQL}")
def end_to_end_status(spark: SparkSession, d: str) -> DataFrame:
    return ev.terminal_summary(_terminal_rows(spark, d), "status", "s", "k")


@register(
    "end_to_end_gate",
    f"""WITH t AS (SELECT *, ceil(samples * 0.95::DOUBLE)::BIGINT AS need, floor(samples * 0.05::DOUBLE)::BIGINT AS allow FROM {SUMMARY_SQL}),
    l AS (SELECT samples, need, allow, list_filter([CASE WHEN NOT strict >= need THEN 'strict_rate' END, CASE WHEN catastrophic <> 0 THEN 'no_catastrophe' END, CASE WHEN NOT manual <= allow THEN 'manual_rate' END], lambda z: z IS NOT NULL) AS fl FROM t)
    SELECT samples, need AS needed_strict, allow AS allowed_manual, len(fl) = 0 AS passed, array_to_string(fl, ',') AS failed FROM l""",
)
def end_to_end_gate(spark: SparkSession, d: str) -> DataFrame:
    return ev.terminal_gate(ev.terminal_summary(_terminal_rows(spark, d), "status", "s", "k"))


@register(
    "work_summary_p95",
    """WITH v AS (SELECT event_type, floor(value / 10)::BIGINT AS x FROM events), s AS (SELECT event_type, list_sort(list(x)) AS l, count(*) AS n, count(*) FILTER (x > 0) AS a, max(x) AS m, sum(x)::DOUBLE / count(*) AS mean FROM v GROUP BY 1)
    SELECT event_type, n AS samples, mean, a::DOUBLE / n AS active_rate, l[ceil((n - 1) * 0.95::DOUBLE)::BIGINT + 1] AS p95, m AS most FROM s""",
)
def work_summary_p95(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.floor(F.col("value") / 10).cast("long").alias("x"))
    return ev.work_summary(rows, "x", ["event_type"])


@register("nearest_rank_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


def _quads(spark: SparkSession, d: str) -> DataFrame:
    """Elements 1-8 and 9-16 of an embedding as corners around those of a fixed frame."""
    base = [100, 100, 900, 100, 900, 700, 100, 700]
    at = lambda i, k: F.element_at("embedding", i + k + 1).cast("double") * 100 + base[k]
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", "label", g.quad(*[at(0, k) for k in range(8)]).alias("q"), g.quad(*[at(8, k) for k in range(8)]).alias("t"))


WIDTH, HEIGHT = 1000.0, 800.0
_XY = [("x", 100), ("y", 100), ("x", 900), ("y", 100), ("x", 900), ("y", 700), ("x", 100), ("y", 700)]
_COLS = ", ".join(f"embedding[{o + k + 1}]::DOUBLE * 100 + {_XY[k][1]} AS {n}{_XY[k][0]}{k // 2}" for n, o in (("p", 0), ("t", 8)) for k in range(8))
QUAD_SQL = f"(SELECT vec_id, label, {_COLS} FROM embeddings)"
_GAPS = ", ".join(f"sqrt((px{i} - tx{i}) * (px{i} - tx{i}) + (py{i} - ty{i}) * (py{i} - ty{i})) AS d{i}" for i in range(4))
GAP_SQL = f"(SELECT *, {_GAPS} FROM {QUAD_SQL})"


@register("quad_errors", f"SELECT vec_id, round(greatest(d0, d1, d2, d3), 4) AS p95_px, round(greatest(d0, d1, d2, d3) / sqrt(1640000.0::DOUBLE), 6) AS max_normalized, round((d0 + d1 + d2 + d3) / 4 / sqrt(1640000.0::DOUBLE), 6) AS mean_normalized, ((d0 > 2)::INT + (d1 > 2)::INT + (d2 > 2)::INT + (d3 > 2)::INT) AS moved, greatest(d0, d1, d2, d3) / sqrt(1640000.0::DOUBLE) <= 0.005 AS strict FROM {GAP_SQL}")
def quad_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.quad_errors(_quads(spark, d), F.col("q"), F.col("t"), F.lit(WIDTH), F.lit(HEIGHT))
    return rows.select("vec_id", F.round("p95_px", 4).alias("p95_px"), F.round("max_normalized", 6).alias("max_normalized"), F.round("mean_normalized", 6).alias("mean_normalized"), "moved", "strict")


_AREA = " + ".join(f"(px{i} * py{(i + 1) % 4} - px{(i + 1) % 4} * py{i})" for i in range(4))


@register("quad_area", f"SELECT vec_id, round(({_AREA}) / 2, 3) AS area, round(abs(({_AREA}) / 2) / 800000.0, 6) AS share FROM {QUAD_SQL}")
def quad_area(spark: SparkSession, d: str) -> DataFrame:
    return _quads(spark, d).select("vec_id", F.round(g.signed_area(F.col("q")), 3).alias("area"), F.round(g.area_ratio(F.col("q"), F.lit(WIDTH), F.lit(HEIGHT)), 6).alias("share"))


@register("first_strict_rank", f"SELECT label, min(CASE WHEN greatest(d0, d1, d2, d3) / sqrt(1640000.0::DOUBLE) <= 0.02 THEN r END) AS first_hit FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM {GAP_SQL}) GROUP BY 1")
def first_strict_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = _quads(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return ranking.first_hit(rows, ["label"], "r", g.is_strict(F.col("q"), F.col("t"), F.lit(WIDTH), F.lit(HEIGHT), 0.02))


@register("slices_labels", f"""WITH s AS (SELECT *, {", ".join(f"sqrt((px{i}-px{(i+1)%4})*(px{i}-px{(i+1)%4})+(py{i}-py{(i+1)%4})*(py{i}-py{(i+1)%4})) AS e{i}" for i in range(4))}, {", ".join(f"(px{(i+1)%4}-px{i})*(py{(i+2)%4}-py{(i+1)%4})-(py{(i+1)%4}-py{i})*(px{(i+2)%4}-px{(i+1)%4}) AS c{i}" for i in range(4))} FROM {QUAD_SQL})
    SELECT vec_id, array_to_string(list_sort(list_filter(['label_' || label::VARCHAR, CASE WHEN greatest(e0,e1,e2,e3) / least(e0,e1,e2,e3) > 1.02 THEN 'perspective' END, CASE WHEN greatest(c0,c1,c2,c3) > 0 AND least(c0,c1,c2,c3) < 0 THEN 'complex_texture' END], lambda z: z IS NOT NULL)), ',') AS slices FROM s""")
def slices_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = F.array(F.concat(F.lit("label_"), F.col("label").cast("string")))
    return _quads(spark, d).select("vec_id", F.array_join(ev.derive_slices(labels, F.col("q"), F.lit(100000.0), F.lit(100000.0)), ",").alias("slices"))


@register("source_rank", "SELECT event_id, percent_rank() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank_fraction FROM events")
def source_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return ranking.rank_fraction(rows, ["event_type"], [F.col("value").desc(), F.col("event_id")]).select("event_id", "rank_fraction")


@register("minmax_prior", "SELECT event_id, (value - lo) / (hi - lo) AS prior FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type)")
def minmax_prior(spark: SparkSession, d: str) -> DataFrame:
    return ranking.scaled_prior(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "prior")


@register("shortlist", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS b FROM events) WHERE a <= 5 OR b <= 2")
def shortlist(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return ranking.shortlist(rows, ["user_id"], "event_type", [F.col("value").desc(), F.col("event_id")], 5, 2).select("user_id", "event_id")


@register("top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranking.top_k(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@register("agg_hypotheses", "SELECT l_partkey, max_by(l_orderkey, l_extendedprice * 1000000000 + l_orderkey * 10 + l_linenumber) AS l_orderkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate) AS dates FROM lineitem GROUP BY 1")
def agg_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("l_extendedprice") * 1000000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_shipdate")
    return ranking.best_with_support(rows, ["l_partkey"], score, [], ["l_orderkey"], {"suppliers": "l_suppkey", "dates": "l_shipdate"})


@register("nearest_pair", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS o, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT vec_id, o AS nearest_id, round(dist, 5) AS distance FROM p WHERE r = 1""")
def nearest_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return ranking.nearest_other(rows, ["label"], "vec_id", "v").withColumn("distance", F.round("distance", 5))


@register("structured_min", """WITH o AS (SELECT l_suppkey AS k, (l_linenumber - 1) % 4 AS s, l_orderkey * 10 + l_linenumber AS id, l_tax * 100 + l_discount * 10000 AS r FROM lineitem), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY r, id) AS n FROM o) WHERE n <= 8),
    c AS (SELECT a.k, greatest(a.r, b.r, c.r, d.r) AS worst, a.r + b.r + c.r + d.r AS sm, a.id AS i, b.id AS j, c.id AS l, d.id AS m FROM b a JOIN b ON b.k = a.k AND b.s = 1 JOIN b c ON c.k = a.k AND c.s = 2 JOIN b d ON d.k = a.k AND d.s = 3 WHERE a.s = 0)
    SELECT k, round(worst, 6) AS worst, round(sm, 6) AS sum FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY worst, sm, i, j, l, m) AS n FROM c) WHERE n = 1""")
def structured_min(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), ((F.col("l_linenumber") - 1) % 4).alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_tax") * 100 + F.col("l_discount") * 10000).alias("r"))
    best = ranking.structured_choice(rows, "k", "s", "id", "r")
    return best.where("worst is not null").select("k", F.round("worst", 6).alias("worst"), F.round("sum", 6).alias("sum"))


@register("min_gap_runs", """WITH m AS (SELECT user_id, value > 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, f, g, count(*) AS n FROM m GROUP BY 1, 2, 3)
    SELECT user_id, sum(n)::BIGINT AS rows, coalesce(max(n) FILTER (NOT f), 0) AS longest, coalesce(max(n) FILTER (NOT f), 0)::DOUBLE / sum(n)::DOUBLE AS share FROM r GROUP BY 1""")
def min_gap_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") > 50).alias("f"))
    return sequences.longest_false_by_group(rows, ["user_id"], ["ts", "event_id"], "f")


@register("local_peaks", "SELECT event_type, day, n FROM (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS q FROM (SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY day)) WHERE n >= p AND n > q")
def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.peaks(daily, ["event_type"], ["day"], "n")


@register("merged_intervals", """WITH i AS (SELECT l_suppkey AS k, epoch_ms(l_shipdate) // 86400000 AS s, epoch_ms(l_shipdate) // 86400000 + l_linenumber AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    r AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k, min(s) AS s, max(e) AS e, count(*) AS parts FROM r GROUP BY k, g""")
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("s"), (day + F.col("l_linenumber")).alias("e"))
    return sequences.merged_intervals(rows, ["k"], "s", "e")


DECIDE_SQL = """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'manual_review' WHEN c_acctbal > 0 AND c_acctbal / 10000 >= 0.85 AND c_nationkey % 5 <> 0 THEN 'accept_first' WHEN c_custkey % 3 <> 0 THEN 'run_second' WHEN c_acctbal > 0 AND c_custkey % 2 = 0 THEN 'accept_first' WHEN c_nationkey > 12 AND (c_acctbal / 10000 < 0.65 OR c_nationkey % 5 = 0) THEN 'accept_second' ELSE 'manual_review' END AS outcome,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'terminal_status' WHEN c_acctbal > 0 AND c_acctbal / 10000 >= 0.85 AND c_nationkey % 5 <> 0 THEN 'safe' WHEN c_custkey % 3 <> 0 THEN 'low_confidence' WHEN c_acctbal > 0 AND c_custkey % 2 = 0 THEN 'cross_agreement' WHEN c_nationkey > 12 AND (c_acctbal / 10000 < 0.65 OR c_nationkey % 5 = 0) THEN 'strong_evidence' ELSE 'cross_conflict' END AS reason FROM customer"""


@register("decide_when", DECIDE_SQL)
def decide_when(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    status = F.when(c("c_mktsegment") == "MACHINERY", "error").otherwise("success")
    made = dec.choose_detector(status, c("c_acctbal") > 0, c("c_acctbal") / 10000, c("c_nationkey") % 5 == 0, c("c_custkey") % 3 == 0, c("c_custkey") % 2 == 0, c("c_nationkey") > 12)
    return table(spark, d, "customer").select("c_custkey", made.alias("m")).select("c_custkey", "m.outcome", "m.reason")


_W = [round(0.05 * (i % 7) - 0.15, 4) for i in range(8)]
_SCORE = " + ".join(f"(embedding[{i + 1}]::DOUBLE - 0.1::DOUBLE) / 0.5::DOUBLE * {w}::DOUBLE" for i, w in enumerate(_W))


@register("logistic_score", f"SELECT vec_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.2::DOUBLE + {_SCORE}))), 9) AS probability FROM embeddings")
def logistic_score(spark: SparkSession, d: str) -> DataFrame:
    features = F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 8)
    score = st.linear_score(features, [0.1] * 8, [0.5] * 8, _W, 0.2)
    return table(spark, d, "embeddings").select("vec_id", F.round(st.logistic(score), 9).alias("probability"))


@register("hourly_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n")


@register("validated_events", "SELECT event_id FROM events WHERE length(trim(event_type)) > 0 AND value >= 0 AND props LIKE '{%'")
def validated_events(spark: SparkSession, d: str) -> DataFrame:
    ok = ~ident.is_blank(F.col("event_type")) & (F.col("value") >= 0) & F.get_json_object("props", "$").startswith("{")
    return table(spark, d, "events").where(ok).select("event_id")


@register("join_orders_lines", "SELECT o_orderpriority, l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def join_orders_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey")
    return rows.groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


LINE_SQL = "(SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_linenumber * 10.0::DOUBLE AS x1, l_quantity::DOUBLE AS y1, l_linenumber * 10 + l_quantity AS x2, l_quantity + (l_orderkey % 9)::DOUBLE AS y2 FROM lineitem)"


@register(
    "best_lines",
    f"""WITH a AS (SELECT *, CASE WHEN x1 = x2 THEN 90.0::DOUBLE ELSE degrees(atan2(y2 - y1, x2 - x1)) END AS g FROM {LINE_SQL}), k AS (SELECT *, CASE WHEN least(g, abs(g - 180)) < 15 THEN 'horizontal' WHEN abs(g - 90) < 15 THEN 'vertical' ELSE 'unknown' END AS kind FROM a),
    s AS (SELECT *, CASE WHEN kind = 'horizontal' THEN 0.4::DOUBLE * (1 - least((y1 + y2) / 2, 100.0::DOUBLE - (y1 + y2) / 2) / 100.0::DOUBLE) + 0.4::DOUBLE * (sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / sqrt(50000.0::DOUBLE)) + 0.2::DOUBLE * (1 - least(g, abs(g - 180)) / 90) WHEN kind = 'vertical' THEN 0.4::DOUBLE * (1 - least((x1 + x2) / 2, 200.0::DOUBLE - (x1 + x2) / 2) / 200.0::DOUBLE) + 0.4::DOUBLE * (sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / sqrt(50000.0::DOUBLE)) + 0.2::DOUBLE * (1 - abs(g - 90) / 90) END AS score FROM k)
    SELECT l_suppkey, kind, round(max(score), 6) AS score, count(*) AS lines FROM s WHERE kind <> 'unknown' GROUP BY 1, 2""",
)
def best_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    line = F.struct((c("l_linenumber") * 10.0).alias("x1"), c("l_quantity").alias("y1"), (c("l_linenumber") * 10 + c("l_quantity")).alias("x2"), (c("l_quantity") + c("l_orderkey") % 9).alias("y2"))
    rows = table(spark, d, "lineitem").select("l_suppkey", ln.classified(line, F.lit(200.0), F.lit(100.0)).alias("m")).where("m.kind <> 'unknown'")
    return rows.groupBy("l_suppkey", c("m.kind").alias("kind")).agg(F.round(F.max("m.score"), 6).alias("score"), F.count(F.lit(1)).alias("lines"))


@register("output_size", f"SELECT vec_id, floor(greatest(sqrt((px0-px1)*(px0-px1)+(py0-py1)*(py0-py1)), sqrt((px2-px3)*(px2-px3)+(py2-py3)*(py2-py3))))::BIGINT AS width, floor(greatest(sqrt((px1-px2)*(px1-px2)+(py1-py2)*(py1-py2)), sqrt((px3-px0)*(px3-px0)+(py3-py0)*(py3-py0))))::BIGINT AS height FROM {QUAD_SQL}")
def output_size(spark: SparkSession, d: str) -> DataFrame:
    rows = _quads(spark, d).select("vec_id", g.output_size(F.col("q")).alias("s"))
    return rows.select("vec_id", F.floor("s.width").cast("long").alias("width"), F.floor("s.height").cast("long").alias("height"))


@register("annotation_validation", "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'schema_version' WHEN c_custkey % 7 = 0 THEN 'ids' WHEN c_custkey % 3 = 0 THEN 'confirmation' WHEN c_custkey % 11 = 0 THEN 'confirmed_at' END AS reason FROM customer")
def annotation_validation(spark: SparkSession, d: str) -> DataFrame:
    """Annotation events made from customers, some of them broken in a known way."""
    k = F.col("c_custkey")
    corners = lambda shift: F.array(*[F.array((F.lit(x) + (shift if i == 2 else 0)).cast("int"), F.lit(y)) for i, (x, y) in enumerate([(10, 10), (110, 10), (110, 70), (10, 70)])])
    rows = table(spark, d, "customer").select(
        k.alias("k"), F.when(k % 5 == 0, 9).otherwise(2).alias("schema_version"), F.concat(F.lit("a"), k.cast("string")).alias("annotation_id"), F.when(k % 7 == 0, " ").otherwise("i").alias("image_id"), F.lit("r").alias("run_id"),
        corners(F.lit(0)).alias("algorithm_boundary_corners"), corners(k % 4).alias("boundary_corners"), F.lit(5).cast("long").alias("confirmation_duration_ms"),
        F.when(k % 11 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+00:00").alias("confirmed_at"), F.lit(None).cast("string").alias("supersedes_annotation_id"), F.lit("2.0").alias("gui_version"),
    )
    made = validation.build_annotations(rows).withColumn("confirmation", F.when(F.col("k") % 3 == 0, "unsure").otherwise(F.col("confirmation")))
    return made.select("k", validation.first_broken(validation.annotation_rules()).alias("reason"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of one picture a label value and block of ids: providers by id, corners and scores from the vector."""
    rows = table(spark, d, "embeddings")
    corners = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 100)
    return rows.select(F.concat_ws("/", F.col("label").cast("string"), F.floor(F.col("vec_id") / 100).cast("string")).alias("image"), F.concat(F.lit("p"), (F.col("vec_id") % 3).cast("string")).alias("provider"), F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("candidate"), corners.alias("corners"), F.element_at("embedding", 9).cast("double").alias("score"))


@register("fuse_round_robin")
def fuse_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(_candidates(spark, d), "image", "provider", "candidate", "corners", "score", 1280.0)


@register("diverse_top_k")
def diverse_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diverse_top_k(_candidates(spark, d), "image", "candidate", "provider", "corners", "score", 1280.0)


@register("complete_link")
def complete_link(spark: SparkSession, d: str) -> DataFrame:
    return ranking.complete_link_clusters(_candidates(spark, d), "image", "candidate", ["candidate"], "corners", 1280.0, 0.02)


@register("study_arms")
def study_arms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample"), F.concat_ws("/", "lang", "source").alias("group"), "lang")
    return ev.study_arms(rows, "sample", "group", "lang", 3)


@register("bootstrap")
def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    rows = table(spark, d, "labels").join(docs, "doc_id").select("lang", (F.col("quality") == 1).cast("int").alias("a"), (F.col("toxic") == 1).cast("int").alias("b"))
    return ev.bootstrap_delta(rows, "a", "b", "lang", seed=5)


@register("canonical_ids")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct("user_id", "event_type", "props", "event_id")).alias("body"))
    return rows.select("event_id", F.concat(F.lit("event_"), ident.canonical_hash(F.col("body"), without=("event_id",))).alias("identity"))



from . import candidate_queries, choice_queries, evidence_queries, feature_queries, raster_queries, record_queries, sample_queries, state_queries  # noqa: E402, F401  these register their queries here
