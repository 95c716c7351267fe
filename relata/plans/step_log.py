"""Step outputs of an import on shared storage, with a log that says which steps are complete."""

from __future__ import annotations

import hashlib
import json
import posixpath

from pyspark.sql import DataFrame, SparkSession

from relata.sources import fs


class StepLog:
    """``<root>/<mark>/<step>/<frame>`` holds frames, ``<root>/<mark>/<step>.json`` says that the step is complete.

    ``mark`` is a digest of the import's definition: a changed definition
    begins anew.  A step that was interrupted has no log entry, and its frames
    are overwritten when it runs again.
    """

    def __init__(self, spark: SparkSession, root: str, definition: str):
        self.spark = spark
        mark = hashlib.sha256(definition.encode()).hexdigest()[:16]
        self.root = posixpath.join(root, mark)

    def _entry(self, step: str) -> str:
        return posixpath.join(self.root, f"{step}.json")

    def _path(self, step: str, name: str) -> str:
        return posixpath.join(self.root, step, name)

    def write(self, step: str, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(step, name))
        return self.frame(step, name)

    def frame(self, step: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(step, name))

    def read(self, step: str) -> dict | None:
        path = self._entry(step)
        return json.loads(fs.read_text(self.spark, path)) if fs.exists(self.spark, path) else None

    def finish(self, step: str, res: dict, frames: list[str], seconds: float) -> None:
        fs.write_text(self.spark, self._entry(step), json.dumps({"res": res, "frames": frames, "seconds": seconds}, default=str))
