"""Confirmations that go into two tables, a phase at a time, so that a run that breaks off anywhere can be taken up again.

A confirmation is prepared (with a snapshot of what is to be stored), its annotation is stored, and two further phases say so. Each phase of a
batch is one part of a table, published in one step under the batch's number; a part that is there isn't written again, and later
phases are made from the stored snapshot, not from the batch. Events have ids made from what they say, so events of one confirmation that
is sent in several batches are stored once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import changed_corners
from ..sources import scratch

# The phases in order, and the one of a confirmation that was given up.
PREPARED, STORED, DONE, ABORTED = "PREPARED", "ANNOTATION_COMMITTED", "FEEDBACK_COMMITTED", "ABORTED"
CORNERS = "array<array<double>>"
ANNOTATION = f"annotation_id string, image_id string, run_id string, algorithm_boundary_corners {CORNERS}, boundary_corners {CORNERS}, confirmation string, adjusted_corner_indices array<int>, confirmation_duration_ms long"
FEEDBACK = f"event_id string, transaction_phase string, annotation_id string, image_id string, run_id string, algorithm_boundary_corners {CORNERS}, boundary_corners {CORNERS}, annotation_event struct<{ANNOTATION.replace(' ', ':').replace(',:', ',')}>"
BOUND = ["annotation_id", "image_id", "algorithm_boundary_corners", "boundary_corners"]


class ConfirmationConflictError(RuntimeError):
    """What is stored isn't what was prepared."""


def event_id(phase: str) -> Column:
    said = [F.coalesce(F.col(c), F.lit("")) for c in ("annotation_id", "image_id", "run_id")]
    return F.sha2(F.concat_ws(":", F.lit(phase), *said, F.to_json("algorithm_boundary_corners"), F.to_json("boundary_corners")), 256)


def event(rows: DataFrame, phase: str) -> DataFrame:
    """Feedback of a phase for rows with an annotation's columns; the first has the annotation itself."""
    names = [c.split()[0] for c in ANNOTATION.split(", ")]
    inner = F.struct(*names) if phase in (PREPARED, ABORTED) else F.lit(None)
    made = rows.select(event_id(phase).alias("event_id"), F.lit(phase).alias("transaction_phase"), *[c for c in names if c in FEEDBACK.split(", annotation_event")[0]], inner.alias("annotation_event"))
    return made.select(*[F.col(f.name).cast(f.dataType) for f in _schema(rows.sparkSession, FEEDBACK)])


def _schema(spark: SparkSession, text: str):
    return spark.createDataFrame([], text).schema


def annotations_of(requests: DataFrame) -> DataFrame:
    """The annotations that requests (annotation_id, image_id, run_id, algorithm and boundary corners, duration) ask for, one each."""
    before, after = F.col("algorithm_boundary_corners"), F.col("boundary_corners")
    adjusted = changed_corners(before, after)
    made = requests.withColumn("adjusted_corner_indices", adjusted).withColumn("confirmation", F.when(F.size(adjusted) > 0, "adjusted").otherwise("accepted"))
    rows = made.select(*[F.col(f.name).cast(f.dataType) for f in _schema(requests.sparkSession, ANNOTATION)])
    return rows.dropDuplicates([c.split()[0] for c in ANNOTATION.split(", ")])


@dataclass(frozen=True)
class Confirmations:
    """The tables ``feedback`` and ``annotations`` under ``path``. ``between``: called with the name of each phase that is about to begin."""

    spark: SparkSession
    path: str
    between: Callable[[str], None] = lambda phase: None

    def _table(self, name: str, text: str) -> DataFrame:
        parts = [f"{self.path}/{name}/{p}" for p in scratch.names(self.spark, f"{self.path}/{name}")]
        return self.spark.read.schema(text).parquet(*parts) if parts else self.spark.createDataFrame([], text)

    def feedback(self) -> DataFrame:
        return self._table("feedback", FEEDBACK)

    def annotations(self) -> DataFrame:
        return self._table("annotations", ANNOTATION)

    def _append(self, name: str, part: str, rows: DataFrame) -> None:
        made = f"{self.path}/_made/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(made)
        if not scratch.publish(self.spark, made, f"{self.path}/{name}/{part}"):
            scratch.delete(self.spark, made)

    def _has(self, name: str, part: str) -> bool:
        return scratch.exists(self.spark, f"{self.path}/{name}/{part}")

    def _say(self, epoch: int, phase: str, rows: DataFrame) -> None:
        """Appends a phase's events of a batch, without those that are stored, unless the part is there."""
        part = f"{epoch:020d}-{phase}"
        if not self._has("feedback", part):
            new = event(rows, phase)
            self._append("feedback", part, new.join(self.feedback().select("event_id"), "event_id", "left_anti").select(*new.columns))

    def commit(self, requests: DataFrame, epoch: int) -> None:
        """Takes a batch through all phases; for ``foreachBatch``. A batch that broke off is taken up where it was."""
        self.between(PREPARED)
        self._say(epoch, PREPARED, annotations_of(requests))
        part = f"{epoch:020d}"
        snapshot = self.spark.read.schema(FEEDBACK).parquet(f"{self.path}/feedback/{part}-{PREPARED}").select("annotation_event.*")
        self.between("ANNOTATION")
        if not self._has("annotations", part):
            stored = self.annotations()
            self._refuse(self._mismatched(snapshot, stored))
            twice = snapshot.groupBy("annotation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            self._refuse(twice)
            self._append("annotations", part, snapshot.join(stored.select("annotation_id"), "annotation_id", "left_anti").select(*snapshot.columns))
        self.between(STORED)
        self._say(epoch, STORED, snapshot)
        self.between(DONE)
        self._say(epoch, DONE, snapshot)

    def _mismatched(self, prepared: DataFrame, stored: DataFrame) -> DataFrame:
        """Prepared confirmations whose annotation is stored with another binding."""
        a, b = prepared.alias("a"), stored.alias("b")
        same = F.lit(True)
        for c in BOUND[1:]:
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return a.join(b, F.col("a.annotation_id") == F.col("b.annotation_id")).where(~same).select("a.annotation_id")

    def _refuse(self, odd: DataFrame) -> None:
        if found := odd.limit(5).collect():
            raise ConfirmationConflictError("stored otherwise than prepared: " + ", ".join(str(r["annotation_id"]) for r in found))

    def recover(self) -> int:
        """Ends what was prepared and left open, without its batch: confirmed if its annotation is stored, else aborted. Gives how many.

        An open confirmation whose run has stored another annotation is a conflict, not an absence, and raises.
        """
        told, stored = self.feedback(), self.annotations()
        ended = told.where(F.col("transaction_phase").isin(DONE, ABORTED)).select("annotation_id").distinct()
        still = told.where(F.col("transaction_phase") == PREPARED).join(ended, "annotation_id", "left_anti").select("annotation_event.*")
        self._refuse(self._mismatched(still, stored))
        there = still.join(stored.select("annotation_id"), "annotation_id", "left_semi")
        absent = still.join(stored.select("annotation_id"), "annotation_id", "left_anti")
        self._refuse(absent.join(stored.select("run_id").distinct(), "run_id", "left_semi"))
        new = event(there, STORED).unionByName(event(there, DONE)).unionByName(event(absent, ABORTED)).dropDuplicates(["event_id"])
        count = still.select("annotation_id").distinct().count()
        if count:
            self._append("feedback", f"recovered-{uuid.uuid4().hex}", new.join(told.select("event_id"), "event_id", "left_anti").select(*new.columns))
        return count
