"""Event logs as streams: deduplicated appends, latest per key, lease windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A growing folder of Parquet files; ``files_per_trigger`` bounds a batch as a queue would."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_stream(events: DataFrame, id_columns: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, even if it is sent again within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(id_columns)


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counts = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *by, "n")


def leases(events: DataFrame, time: str, owner: str, ttl: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Spans in which an owner kept renewing before its lease ran out."""
    spans = events.withWatermark(time, late).groupBy(F.session_window(time, ttl), owner).agg(F.count(F.lit(1)).alias("renewals"))
    return spans.select(owner, F.col("session_window.start").alias("held_from"), F.col("session_window.end").alias("expires"), "renewals")


def keep_latest(target_path: str, key: str, order: list[str]):
    """A foreachBatch sink that keeps the latest row of each key: every batch is merged into a new version of the table."""
    from ..operators.logs import latest_by_key

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch > 0:
            rows = rows.unionByName(spark.read.parquet(f"{target_path}/v{epoch - 1}"))
        latest_by_key(rows, [key], order).write.mode("overwrite").parquet(f"{target_path}/v{epoch}")

    return merge
