"""Fronts of unbounded streams. A skyline of skylines is the skyline, so each micro-batch is
reduced to its own front and merged with the one kept so far; the state is a front, not the
stream. Every batch writes a new version in the shared folder. A new start over the same folder
goes on from the newest complete version there, so it repeats at most the batch that it was
in. A folder belongs to one stream's checkpoint, as versions are named after its batches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pareto import front_values, hypervolume


class RunningFront:
    """``merge`` is a foreachBatch function; ``current`` and ``hypervolume`` read its state."""

    def __init__(self, spark: SparkSession, folder: str, y1: str, y2: str, by: Sequence[str] = ()):
        self.spark, self.folder, self.y1, self.y2, self.by = spark, folder.rstrip("/"), y1, y2, list(by)
        complete = self._versions()
        self.version: int | None = max(complete, default=None)

    def _path(self, version: int) -> str:
        return f"{self.folder}/front-{version}"

    def _files(self):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        return context._jvm.org.apache.hadoop.fs.Path, at, at.getFileSystem(context._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Versions whose writing was completed."""
        path, at, files = self._files()
        if not files.exists(at):
            return []
        names = [re.fullmatch(r"front-(\d+)", s.getPath().getName()) for s in files.listStatus(at)]
        return [int(m[1]) for m in names if m and files.exists(path(f"{self.folder}/{m[0]}/_SUCCESS"))]

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if self.version is not None and batch_id <= self.version:
            return  # a repeated batch: its version is written
        fresh = batch.select(*self.by, self.y1, self.y2)
        known = self.current()
        front_values(fresh if known is None else known.unionByName(fresh), self.y1, self.y2, self.by).write.mode("overwrite").parquet(self._path(batch_id))
        before, self.version = self.version, batch_id
        # the version before stays for those who still read it
        path, _, files = self._files()
        for old in self._versions():
            if before is not None and old < before:
                files.delete(path(self._path(old)), True)

    def current(self) -> DataFrame | None:
        return None if self.version is None else self.spark.read.parquet(self._path(self.version))

    def hypervolume(self, ref: tuple[float, float]) -> DataFrame:
        return hypervolume(self.current(), self.y1, self.y2, ref, self.by)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
