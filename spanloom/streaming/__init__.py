"""The change feed as a stream: upserts by last writer, with a state of one row an id."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import Graph, merge_graphs, prune_tombstones
from ..sources.graphs import export

#: How long changes gather before the graph is written.
DEBOUNCE = "5 seconds"
CHANGES = "op string, key string, payload string, ts timestamp"


def latest_changes(changes: DataFrame) -> DataFrame:
    """Of each key the change of the largest time; of equal times the one that deletes."""
    return changes.groupBy("key").agg(
        F.max_by(F.struct("op", "payload", "ts"), F.struct("ts", (F.col("op") == "delete").alias("d"))).alias("c")
    ).select("key", "c.*")


def apply_changes(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, parts: int = 64) -> StreamingQuery:
    """Keeps a table of the latest change of each key below path, until the stream ends; ``current`` reads it.

    The table is dealt to ``parts`` parts by a hash of the key. A batch writes, in one job, only those that it touches, as a new
    version of each, and drops the versions before the last two. A batch that is delivered again starts from the
    versions before it and writes its own again, so the outcome is the same.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")

    def upsert(batch: DataFrame, epoch: int) -> None:
        session, held = batch.sparkSession, _versions(batch.sparkSession, path)
        now = latest_changes(batch)
        touched = [r[0] for r in now.select(part).distinct().collect()]
        before = [f"{path}/v={max(older)}/part={k}" for k in touched if (older := [v for v in held.get(k, []) if v < epoch])]
        if before:
            now = latest_changes(session.read.parquet(*before).select(*now.columns).unionByName(now))
        now.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v={epoch}")
        for k in touched:
            for old in sorted(v for v in held.get(k, []) if v < epoch)[:-1]:
                _drop(session, f"{path}/v={old}/part={k}")

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _drop(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each part that were written whole."""
    out: dict[int, list[int]] = {}
    where, files = _files(spark, f"{path}/v=*/part=*")
    whole = {s.getPath().getParent().getName() for s in files.globStatus(_files(spark, f"{path}/v=*/_SUCCESS")[0]) or []}
    for status in files.globStatus(where) or []:
        version, part = status.getPath().getParent().getName(), status.getPath().getName()
        if version in whole:
            out.setdefault(int(part.split("=")[1]), []).append(int(version.split("=")[1]))
    return out


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest change of each key: the last version of every part."""
    paths = [f"{path}/v={max(versions)}/part={part}" for part, versions in _versions(spark, path).items()]
    return spark.read.schema(CHANGES).parquet(*paths) if paths else spark.createDataFrame([], CHANGES)


def confirmations(events: DataFrame) -> DataFrame:
    """A stateful count by id: first and last time seen and the number of writes, over the whole stream."""
    return events.groupBy("id").agg(F.count(F.lit(1)).alias("confirmationCount"), F.min("ts").alias("firstSeen"), F.max("ts").alias("lastSeen"))


def merge_stream(copies: Callable[[], list[Graph | None]], live: Graph, as_of: str, days: int = 90) -> Graph:
    """Merges what copies() finds into the live graph, all raw copies in one pass (merging pairs would lose relations)."""
    merged = merge_graphs([live, *copies()]).graph
    merged.tombstones = prune_tombstones(merged.tombstones, as_of, days)
    return merged


class DebouncedExport:
    """Exports a graph when no newer one came for ``delay`` seconds, so of a burst of writes only the last is written."""

    def __init__(self, path: str, known: list[str], delay: float = 5.0, files: int = 1):
        self.path, self.known, self.delay, self.files = path, known, delay, files
        self._lock, self._timer, self._waiting = threading.RLock(), None, None

    def schedule(self, graph: Graph) -> None:
        """Takes over the newest graph and starts the wait anew."""
        with self._lock:
            if self._timer:
                self._timer.cancel()
            self._waiting, self._timer = graph, threading.Timer(self.delay, self.flush)
            self._timer.daemon = True
            self._timer.start()

    def flush(self) -> bool:
        """Writes what waits, now; whether something did."""
        with self._lock:
            graph, self._waiting = self._waiting, None
            if self._timer:
                self._timer.cancel()
                self._timer = None
            if graph is not None:
                export(graph, self.path, self.known, self.files)
            return graph is not None


__all__ = ["CHANGES", "DEBOUNCE", "DebouncedExport", "apply_changes", "confirmations", "current", "latest_changes", "merge_stream"]
