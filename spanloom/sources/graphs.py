"""Graphs as files: serialized JSON graphs, bucketed exports, Parquet snapshots, online exports, ontologies, vectors."""

from __future__ import annotations

import os.path
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bucket, is_active
from ..operators.merge import Graph, Merged, merge_graphs, prune_tombstones
from ..plans import ENTITIES, RELATIONS, TOMBSTONES

_MARK = "struct<at:string,meta:struct<project:string,team:string,domain:string>>"
# The names of fields in serialized graphs.
_FIELDS = re.split(r", (?=`?\w+`? (?:bigint|string|struct|array|map))", ENTITIES)[1:]
_ATTRIBUTES = ",".join(re.sub(r"^(\w+) ", r"\1:", f) for f in _FIELDS)
SERIALIZED = (
    f"attributes struct<kmTombstones:struct<entities:map<string,{_MARK}>,relations:map<string,{_MARK}>>>, nodes array<struct<key:string,attributes:struct<{
        _ATTRIBUTES
    }>>>, "
    "edges array<struct<key:string,source:string,target:string,attributes:struct<type:string,metadata:map<string,string>,createdAt:string,validFrom:string,validUntil:string>>>"
)


def _once(paths: list[str]) -> list[str]:
    """The paths, of several that name one file the first."""
    found: dict[tuple[str, str], str] = {}
    for path in paths:
        scheme, _, rest = path.rpartition(":")
        found.setdefault((scheme, os.path.normpath(rest)), path)
    return list(found.values())


def read_json(spark: SparkSession, paths: list[str]) -> list[Graph]:
    """One graph a file, in the order given, each file once however it is spelled; missing edges are none, an
    unreadable file is an empty graph."""
    out = []
    for path in _once(paths):
        raw = spark.read.schema(SERIALIZED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        nodes = raw.select(F.posexplode("nodes").alias("seq", "n")).select("n.attributes.*", F.col("n.key").alias("_key"), "seq")
        names = [f.name for f in spark.createDataFrame([], ENTITIES).schema]
        entities = nodes.withColumns({"id": F.coalesce("id", "_key"), "seq": F.col("seq").cast("long")}).select(*names)
        edges = raw.select(F.posexplode("edges").alias("seq", "e")).select(
            F.col("seq").cast("long"), F.col("e.key").alias("key"), F.col("e.source").alias("from"), F.col("e.target").alias("to"), "e.attributes.*"
        )
        marks = None
        for kind in ("entities", "relations"):
            one = raw.select(F.lit(kind).alias("kind"), F.explode(F.col("attributes.kmTombstones")[kind]).alias("key", "m")).select(
                "kind", "key", "m.at", "m.meta"
            )
            marks = one if marks is None else marks.unionByName(one)
        out.append(Graph(entities, edges.select(*(f.name for f in spark.createDataFrame([], RELATIONS).schema)), marks))
    return out


def read_merged(spark: SparkSession, paths: list[str]) -> tuple[Merged, DataFrame]:
    """The files' graphs as one, and the edges that lack an end with the path of the file that first held them."""
    copies = read_json(spark, paths)
    merged = merge_graphs(list(copies))
    files = spark.createDataFrame(list(enumerate(_once(paths))), "origin int, path string")
    return merged, merged.dangling.join(F.broadcast(files), "origin").drop("origin")


def hydrate(spark: SparkSession, snapshot: str | None, paths: list[str], as_of: str, days: int = 90) -> Merged | None:
    """What a store opens with: the snapshot, if there is one, merged with the exports, old tombstones pruned; None if there is nothing."""
    held = load(spark, snapshot) if snapshot and _exists(spark, f"{snapshot}/entities") else None
    copies = [held, *read_json(spark, [p for p in paths if _exists(spark, p)])]
    if not any(copies):
        return None
    merged = merge_graphs(copies)
    merged.graph.tombstones = prune_tombstones(merged.graph.tombstones, as_of, days)
    return merged


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def tombstones_of(graph: Graph, kind: str = "entities") -> DataFrame:
    """(key, at, meta) of deleted entities, or of deleted relations by triple."""
    return graph.tombstones.where(F.col("kind") == kind).select("key", "at", "meta")


def bucketed(graph: Graph, known: list[str], domain: str = "domain") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities by their own bucket, relations by that of their source, tombstones by that of what was deleted."""
    nodes = graph.entities.withColumn("bucket", bucket(F.col("metadata")[domain], known))
    home = nodes.select(F.col("id").alias("from"), "bucket")
    edges = graph.relations.join(home, "from", "left").withColumn("bucket", F.coalesce("bucket", F.lit("general")))
    return nodes, edges, graph.tombstones.withColumn("bucket", bucket("meta.domain", known))


def export(graph: Graph, path: str, known: list[str], files: int = 1) -> None:
    """JSON lines in a folder a bucket; entities by id, relations by triple, nulls left out. Known empty buckets get no file.

    A bucket has ``files`` files, each sorted, dealt by a hash of what it is sorted by: a bucket that holds nearly all
    rows is no single task's.
    """
    for name, rows, order in zip(("nodes", "edges", "tombstones"), bucketed(graph, known), (["id"], ["from", "type", "to"], ["kind", "key"]), strict=True):
        dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*order), F.lit(files)))
        dealt.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", True).json(f"{path}/{name}")


def read_export(spark: SparkSession, path: str) -> Graph:
    parts = [spark.read.schema(s).json(f"{path}/{n}") for n, s in (("nodes", ENTITIES), ("edges", RELATIONS), ("tombstones", TOMBSTONES))]
    return Graph(*parts)


# ---------------------------------------------------------------- snapshots


def save(graph: Graph, path: str) -> None:
    for name, rows in (("entities", graph.entities), ("relations", graph.relations), ("tombstones", graph.tombstones)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("entities", "relations", "tombstones")))


class Snapshots:
    """Labelled versions of a graph in folders below one path."""

    LABEL, ID = re.compile(r"^[a-z0-9][a-z0-9-]{0,63}$"), re.compile(r"^snapshot/[a-z0-9][a-z0-9-]{0,63}-\d{8}T\d{6}Z$")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, graph: Graph, label: str, at: str) -> str:
        """at: the time as YYYYMMDDTHHMMSSZ."""
        if not self.LABEL.match(label):
            raise ValueError(f"no label: {label}")
        name = f"snapshot/{label}-{at}"
        save(graph, f"{self.path}/{name}")
        self.spark.createDataFrame(
            [(name, label, at)], "id string, label string, createdAt string"
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return name

    def list(self) -> DataFrame:
        """Newest first."""
        return self.spark.read.schema("id string, label string, createdAt string").parquet(f"{self.path}/manifest").orderBy(F.desc("createdAt"), "id")

    def restore(self, id_: str, confirm_destructive: bool = False) -> Graph:
        if not confirm_destructive:
            raise ValueError("a restore replaces the live graph: confirm_destructive must be True")
        if not self.ID.match(id_):
            raise ValueError(f"no snapshot: {id_}")
        return load(self.spark, f"{self.path}/{id_}")


# ---------------------------------------------------------------- other sources


def read_online(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str | None]:
    """A table of an online export, a JSON array; a missing file gives no rows and a warning. SQLite files are refused."""
    if path.endswith(".sqlite"):
        raise ValueError("online exports are read as JSON, not from SQLite")
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), f"{path} does not exist"
    return spark.read.schema(schema).option("multiLine", True).json(path), None


def vector_points(entities: DataFrame, as_of: str) -> DataFrame:
    """(id, vector, payload) of active entities that have a vector."""
    payload = F.struct("entityType", "name", "ontologyClass")
    return entities.where(is_active(as_of) & (F.size("embedding") > 0)).select(
        F.coalesce("legacyId.id", "id").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload")
    )


def sync_vectors(points: DataFrame, upsert: Callable[[list[dict]], None], batch_size: int = 100) -> DataFrame:
    """Sends points in batches from the executors; a row a batch with its size and error, if any."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    def run(rows):
        import pandas as pd

        for frame in rows:
            out = []
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size]
                try:
                    upsert(part.to_dict("records"))
                    out.append((len(part), None))
                except Exception as e:  # a failed batch is reported, the others go on
                    out.append((len(part), str(e)))
            yield pd.DataFrame(out, columns=["points", "error"])

    return points.mapInPandas(run, "points long, error string")
