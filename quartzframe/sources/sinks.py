"""Sinks: write-once documents, validated appends, content-addressed objects, evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.logs import append_new


def write_once(df: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    df.write.mode("errorifexists").parquet(path)


def append_events(stored_path: str, incoming: DataFrame, id_column: str, payload: list[str]) -> int:
    """Appends events that aren't stored; an id stored with another payload raises before anything is written.

    One writer at a time: files give no lock between check and write. Readers collapse repeated ids.
    """
    spark = incoming.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(stored_path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    stored = spark.read.schema(incoming.schema).parquet(stored_path) if there else spark.createDataFrame([], incoming.schema)
    fresh, clash = append_new(stored, incoming, id_column, payload)
    if not clash.isEmpty():
        raise ValueError("an event id is stored with another payload")
    fresh = fresh.persist()
    try:
        count = fresh.count()
        fresh.write.mode("append").parquet(stored_path)
    finally:
        fresh.unpersist()
    return count


def archive_objects(sources: DataFrame, stored: DataFrame, content: str, key: str = "object_key") -> DataFrame:
    """Objects (key, prefix, content) to add: each content once, none that is stored."""
    keyed = sources.select(F.sha2(F.col(content), 256).alias(key), F.col(content).alias("content"))
    once = keyed.groupBy(key).agg(F.first("content").alias("content"))
    return once.join(stored.select(key), key, "left_anti").withColumn("prefix", F.substring(key, 1, 2))


def write_objects(objects: DataFrame, path: str) -> None:
    objects.write.mode("append").partitionBy("prefix").parquet(path)


def write_report(folder: str, tables: dict[str, DataFrame]) -> None:
    """Each table of an evaluation as JSON lines under one run folder, which must be new."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")
