"""Registered queries of keyed state, transactions and rewritten tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch
from ..sources.versions import VersionedTable
from ..streaming import sessions as se
from ..streaming import transactions as tr
from .queries import register, table

C = F.col


@contextmanager
def configured(spark: SparkSession, **conf: str):
    """Settings that hold meanwhile."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


SESSION_LOG_SQL = """
    n AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT user_id, event_id, 3 * n AS seq, (n - 1) // 3 AS expected, CASE WHEN event_id % 97 = 0 THEN 'quit' ELSE CASE event_type WHEN 'signup' THEN 'select_corner' WHEN 'view' THEN 'next' WHEN 'click' THEN 'set_zoom' WHEN 'error' THEN 'previous' ELSE 'confirm' END END AS kind FROM n),
    f AS (SELECT *, (kind = 'select_corner' AND event_id % 5 = 4) OR (kind = 'set_zoom' AND event_id % 5 = 4) AS bad, 0 AS copy FROM b),
    log AS (SELECT * FROM f UNION ALL SELECT user_id, event_id, seq + 1, expected, kind, bad, 1 FROM f WHERE event_id % 5 < 2 UNION ALL SELECT user_id, event_id, seq + 2, expected, 'reset', false, 2 FROM f WHERE event_id % 7 = 0)"""


@register(
    "session_states",
    f"""WITH RECURSIVE {SESSION_LOG_SQL.strip()},
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM log),
    walk AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS revision, 0::BIGINT AS place, 'active' AS status, -1::BIGINT AS last_id, 'none' AS last_kind, 0::BIGINT AS taken, 0::BIGINT AS replayed, 0::BIGINT AS refused FROM log
        UNION ALL
        SELECT user_id, k, CASE WHEN out = 'ok' THEN revision + 1 ELSE revision END,
            CASE WHEN out = 'ok' AND (kind = 'next' OR kind = 'confirm' AND place < 19) THEN place + 1 WHEN out = 'ok' AND kind = 'previous' THEN place - 1 ELSE place END,
            CASE WHEN out = 'ok' AND kind = 'quit' THEN 'quit' WHEN out = 'ok' AND kind = 'confirm' AND place = 19 THEN 'completed' ELSE status END,
            CASE WHEN out = 'ok' THEN event_id ELSE last_id END, CASE WHEN out = 'ok' THEN kind ELSE last_kind END,
            taken + (out = 'ok')::BIGINT, replayed + (out = 'replayed')::BIGINT, refused + (out = 'no')::BIGINT
        FROM (SELECT o.*, w.* EXCLUDE (user_id, k), CASE WHEN bad THEN 'no' WHEN last_id = event_id THEN CASE WHEN kind = last_kind THEN 'replayed' ELSE 'no' END WHEN status <> 'active' OR expected <> revision THEN 'no'
            WHEN kind = 'next' AND place = 19 OR kind = 'previous' AND place = 0 THEN 'no' ELSE 'ok' END AS out FROM walk w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1))
    SELECT user_id, revision, place, status, taken, replayed, refused FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS last FROM walk) WHERE k = last AND k > 0""",
)
def session_states(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as actions of sessions, some sent again and some ids used twice; the log arrives in two parts, between which the stream is stopped."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k, kinds = C("event_id"), {"signup": "select_corner", "view": "next", "click": "set_zoom", "error": "previous", "purchase": "confirm"}
    kind = F.when(k % 97 == 0, "quit").otherwise(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[C("event_type")])
    n = F.row_number().over(own)
    base = table(spark, d, "events").select("user_id", k, "ts", (3 * n).cast("long").alias("seq"), F.floor((n - 1) / 3).alias("expected_revision"), kind.alias("kind"))
    again = base.where("event_id % 5 < 2").withColumn("seq", C("seq") + 1)
    other = base.where("event_id % 7 = 0").withColumn("seq", C("seq") + 2).withColumn("kind", F.lit("reset"))
    fields = {"index": F.when(C("kind") == "select_corner", k % 5), "zoom": F.when(C("kind") == "set_zoom", F.element_at(F.array(*[F.lit(z) for z in (*se.ZOOMS, 3)]), (k % 5 + 1).cast("int")).cast("long"))}
    null = {f: F.lit(None).cast("string" if f == "reason" else "long") for f in se.FIELDS}
    log = base.unionByName(again).unionByName(other).select(C("user_id").cast("string").alias("session"), "seq", k.cast("string").alias("action_id"), "expected_revision", "kind", F.lit(20).alias("items"), "ts", *[v.alias(f) for f, v in (null | fields).items()])
    folder = scratch.shared_folder(spark, "sessions")
    with configured(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        for part in (C("seq") <= 60, C("seq") > 60):
            log.where(part).write.mode("append").parquet(f"{folder}/log")
            outcomes = se.dispatched(spark.readStream.schema(log.schema).parquet(f"{folder}/log"))
            outcomes.writeStream.format("parquet").option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return se.final_states(spark.read.parquet(f"{folder}/outcomes")).withColumnRenamed("session", "user_id").withColumn("user_id", C("user_id").cast("long"))


@register("versioned_rewrite", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS version, o_totalprice FROM orders WHERE o_totalprice > 1000")
def versioned_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A table rewritten as a whole; a later rewrite breaks off and leaves the version before it."""
    versions = VersionedTable(spark, scratch.shared_folder(spark, "versions"))
    versions.publish(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("version"), "o_totalprice"))
    hit = C("o_orderkey") % 3 == 0
    versions.rewrite(lambda t: t.where("o_totalprice > 1000").withColumn("o_orderstatus", F.when(hit, "X").otherwise(C("o_orderstatus"))).withColumn("version", F.when(hit, 1).otherwise(0)))
    try:
        versions.rewrite(lambda t: t.withColumn("o_totalprice", F.when(C("o_orderkey") % 4 == 1, F.raise_error(F.lit("broken off")).cast("double")).otherwise(C("o_totalprice"))))
    except Exception as e:
        if "broken off" not in str(e):
            raise
    return versions.read()


class BrokenOffError(RuntimeError):
    """The planted end of a run."""


TRANSACTION_SQL = """WITH r AS (SELECT 'a' || event_id AS annotation_id, 'i' || user_id AS image_id, 'r' || event_id % 10 AS run_id,
    [[10.0, 20.0], [110.0, 20.0], [110.0, 90.0], [10.0, 90.0]]::DOUBLE[][] AS before, [[10.0 + event_id % 3, 20.0], [110.0, 20.0], [110.0, 90.0], [10.0, 90.0]]::DOUBLE[][] AS after FROM events WHERE event_type = 'purchase'),
    p AS (SELECT unnest(['PREPARED', 'ANNOTATION_COMMITTED', 'FEEDBACK_COMMITTED']) AS said)"""


@register(
    "confirmation_transactions",
    TRANSACTION_SQL
    + """ SELECT sha256(concat_ws(':', said, annotation_id, image_id, run_id, replace(to_json(before)::VARCHAR, ' ', ''), replace(to_json(after)::VARCHAR, ' ', ''))) AS id, said, annotation_id, image_id, NULL AS confirmation FROM r, p
    UNION ALL SELECT annotation_id, 'ANNOTATION', annotation_id, image_id, CASE WHEN before = after THEN 'accepted' ELSE 'adjusted' END FROM r""",
)
def confirmation_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as confirmations, in a stream that breaks off before each phase in turn and is started again; both tables."""
    k, folder = C("event_id"), scratch.shared_folder(spark, "confirmations")
    point = lambda x, y: F.array(x.cast("double"), F.lit(y).cast("double"))
    quad = lambda x: F.array(point(x, 20), point(F.lit(110), 20), point(F.lit(110), 90), point(F.lit(10), 90))
    requests = table(spark, d, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("a"), k).alias("annotation_id"), F.concat(F.lit("i"), C("user_id")).alias("image_id"), F.concat(F.lit("r"), k % 10).alias("run_id"),
        quad(F.lit(10)).alias("algorithm_boundary_corners"), quad(10 + k % 3).alias("boundary_corners"), k.alias("confirmation_duration_ms"),
    )
    requests.write.parquet(f"{folder}/requests")
    stops = [tr.PREPARED, "ANNOTATION", tr.STORED, tr.DONE]

    def between(phase: str) -> None:
        if stops and stops[0] == phase:
            stops.pop(0)
            raise BrokenOffError(phase)

    tables = tr.Confirmations(spark, f"{folder}/tables", between)
    for left in range(len(stops), -1, -1):
        stream = spark.readStream.schema(requests.schema).parquet(f"{folder}/requests")
        query = stream.writeStream.foreachBatch(tables.commit).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            if not left or "BrokenOffError" not in str(e):
                raise
    told = tables.feedback().select(C("event_id").alias("id"), C("transaction_phase").alias("said"), "annotation_id", "image_id", F.lit(None).cast("string").alias("confirmation"))
    return told.unionByName(tables.annotations().select(C("annotation_id").alias("id"), F.lit("ANNOTATION").alias("said"), "annotation_id", "image_id", "confirmation"))
