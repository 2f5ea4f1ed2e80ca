"""Tables that are rewritten as a whole: each version is a folder of its own, and a pointer that is published in one step names it.

A reader takes the pointer of the highest number and so sees one version, whatever is being written; a write that fails leaves a folder
that no pointer names. Two writers that began at one version can't both publish: the second is refused and may try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import scratch


class VersionConflictError(RuntimeError):
    """Another writer published a version meanwhile."""


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return [int(n) for n in scratch.names(self.spark, f"{self.path}/pointers") if n.isdigit()]

    def _pointer(self, version: int) -> str:
        return f"{self.path}/pointers/{version:020d}"

    def _folder(self, version: int) -> str:
        return f"{self.path}/data/{json.loads(scratch.read_text(self.spark, self._pointer(version)))['folder']}"

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the latest if none is given; raises FileNotFoundError before the first."""
        found = self.versions()
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"no version {version} of {self.path}")
        return self.spark.read.parquet(self._folder(found[-1] if version is None else version))

    def publish(self, df: DataFrame, expected: int | None = None) -> int:
        """Writes ``df`` and makes it the next version. ``expected``: the version that ``df`` was made from; another one since then is a conflict."""
        last = max(self.versions(), default=-1)
        if expected is not None and expected != last:
            raise VersionConflictError(f"version {last} is there, {expected} was expected")
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{folder}")
        if not scratch.write_text(self.spark, self._pointer(last + 1), json.dumps({"folder": folder})):
            scratch.delete(self.spark, f"{self.path}/data/{folder}")
            raise VersionConflictError(f"version {last + 1} was published meanwhile")
        return last + 1

    def rewrite(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Publishes ``change`` of the latest version, from the start again after a conflict."""
        for left in range(attempts - 1, -1, -1):
            last = max(self.versions(), default=-1)
            try:
                return self.publish(change(self.read(last)), last)
            except VersionConflictError:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` versions and folders that no pointer names; gives the folders' names. Not while another writes."""
        found = self.versions()
        kept = {self._folder(v).rsplit("/", 1)[1] for v in found[-keep:]}
        for v in found[:-keep]:
            scratch.delete(self.spark, self._pointer(v))
        gone = [n for n in scratch.names(self.spark, f"{self.path}/data") if n not in kept]
        for n in gone:
            scratch.delete(self.spark, f"{self.path}/data/{n}")
        return gone
