"""Exact counts of arriving files as levelled runs, so that a batch writes in proportion to itself.

Each batch's counts by key are written as one run at level 0: a Parquet folder cut into ``buckets`` files by hash of the key
and sorted within each file. Once a level holds ``fanout`` runs they are merged (summed by key) into one run of the next
level, and so on up. What the state is after batch ``b`` is told by its manifest, a folder of empty files named after the live
runs, written under a temporary name and renamed when all runs are in place. A reader sums the runs of the newest
manifest by key.

A row of a batch is written once at level 0 and once more at each level it is merged into, so the bytes written grow with
``log(batches) / log(fanout)`` times the input, not with the size of the state. A stop anywhere before the rename leaves the
older manifest in force; the batch then runs again from that manifest and writes runs of the same names. Runs that no
manifest younger than the one before names are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT, BUCKETS = 4, 8


class LevelledCounts:
    """Counts ``count`` by ``keys`` under the folder ``where`` (one that all executors reach)."""

    def __init__(self, spark: SparkSession, where: str, keys: list[str], count: str = "count", fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.where, self.keys, self.count = spark, where.rstrip("/"), keys, count
        self.fanout, self.buckets = fanout, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.where).getFileSystem(spark._jsc.hadoopConfiguration())
        #: Bytes of each run written by this object, by batch and run name.
        self.written: dict[int, dict[str, int]] = {}

    # -- manifests --------------------------------------------------------------------------------------------------
    def _manifest_dir(self, batch: int) -> str:
        return f"{self.where}/manifests/batch={batch}"

    def batches(self) -> list[int]:
        """Batches whose manifest is complete."""
        root = self._path(f"{self.where}/manifests")
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def runs(self, batch: int | None = None) -> list[tuple[int, str]]:
        """``(level, name)`` of the live runs after ``batch`` (the newest if None); none before the first."""
        done = self.batches()
        if batch is None:
            batch = done[-1] if done else None
        if batch is None or batch not in done:
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._manifest_dir(batch)))]
        return sorted((int(n.split("-")[0][1:]), n) for n in names)

    def _write_manifest(self, batch: int, runs: list[tuple[int, str]]) -> None:
        temp = f"{self.where}/manifests/_temp-{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(temp))
        for _, name in runs:
            self._fs.create(self._path(f"{temp}/{name}")).close()
        final = self._path(self._manifest_dir(batch))
        if self._fs.exists(final):  # a repeated batch replaces its own manifest
            self._fs.delete(final, True)
        self._fs.rename(self._path(temp), final)

    # -- runs -------------------------------------------------------------------------------------------------------
    def run_path(self, name: str) -> str:
        return f"{self.where}/runs/{name}"

    def _write_run(self, counts: DataFrame, name: str) -> int:
        summed = counts.groupBy(*self.keys).agg(F.sum(self.count).alias(self.count))
        laid = summed.repartition(self.buckets, *self.keys).sortWithinPartitions(*self.keys)
        laid.write.mode("overwrite").parquet(self.run_path(name))
        return self._fs.getContentSummary(self._path(self.run_path(name))).getLength()

    def _read(self, runs: list[tuple[int, str]]) -> DataFrame | None:
        if not runs:
            return None
        return self.spark.read.parquet(*[self.run_path(n) for _, n in runs])

    def absorb(self, counts: DataFrame, batch: int) -> None:
        """Adds ``counts`` (``keys`` and ``count``) as batch ``batch``: a level-0 run, merges as needed, then the manifest."""
        before = [b for b in self.batches() if b < batch]
        runs = self.runs(before[-1]) if before else []
        runs = [*runs, (0, f"L0-b{batch}")]
        written = self.written[batch] = {f"L0-b{batch}": self._write_run(counts, f"L0-b{batch}")}
        level = 0
        while True:
            at_level = [r for r in runs if r[0] == level]
            if len(at_level) < self.fanout:
                break
            name = f"L{level + 1}-b{batch}"
            written[name] = self._write_run(self._read(at_level), name)
            runs = [r for r in runs if r[0] != level] + [(level + 1, name)]
            level += 1
        self._write_manifest(batch, runs)
        self._collect(batch)

    def _collect(self, batch: int) -> None:
        """Deletes manifests older than the one before ``batch`` and runs that neither of the two names."""
        done = [b for b in self.batches() if b <= batch]
        keep = done[-2:]
        for b in done[:-2]:
            self._fs.delete(self._path(self._manifest_dir(b)), True)
        live = {n for b in keep for _, n in self.runs(b)}
        root = self._path(f"{self.where}/runs")
        if self._fs.exists(root):
            for s in self._fs.listStatus(root):
                if s.getPath().getName() not in live:
                    self._fs.delete(s.getPath(), True)

    def state(self, batch: int | None = None) -> DataFrame:
        """The counts after ``batch`` (the newest if None), summed over the live runs."""
        runs = self.runs(batch)
        if not runs:
            raise ValueError("no batch has been absorbed yet")
        return self._read(runs).groupBy(*self.keys).agg(F.sum(self.count).alias(self.count))


def run_levelled(stream: DataFrame, where: str, counts: Callable[[DataFrame], DataFrame], keys: list[str], count: str = "count", fanout: int = FANOUT) -> DataFrame:
    """Absorbs every file of ``stream`` not seen yet into the levelled counts under ``where`` and returns them.

    ``counts`` turns a batch of rows into ``keys`` and ``count``. The engine's checkpoint is kept in the same folder, so
    calling this again reads new files only.
    """
    spark = stream.sparkSession
    state = LevelledCounts(spark, f"{where}/levels", keys, count, fanout)

    def absorb(batch: DataFrame, batch_id: int) -> None:
        state.absorb(counts(batch), batch_id)

    query = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.state()
