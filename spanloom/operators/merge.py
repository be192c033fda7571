"""Union merge of several copies of a graph: last writer wins, with tombstones.

The merge is not associative, so all copies go in at once; a copy's place in the list breaks ties.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_stamp, relation_key, stamp_ms


@dataclass
class Graph:
    """A copy: entities, relations and tombstones."""

    entities: DataFrame
    relations: DataFrame
    tombstones: DataFrame


@dataclass
class Merged:
    graph: Graph
    dangling: DataFrame
    stats: DataFrame


def _stacked(parts: list[DataFrame | None]) -> DataFrame:
    found = [p.withColumn("src", F.lit(k)) for k, p in enumerate(parts) if p is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _latest(rows: DataFrame, key: list[str], stamp: Column, strict_updates: bool = False, of_first: tuple[str, ...] = ()) -> DataFrame:
    """The row of the largest stamp of each key, ties to the earliest source; first_src and first_seq of its first sighting.

    Columns of_first are those of the first sighting."""
    order = F.struct(F.col("stamp"), -F.col("src"), -F.col("seq"))
    first = F.min(F.struct("src", "seq"))
    rows = rows.withColumn("stamp", stamp)
    whole = F.struct(*[c for c in rows.columns if c not in (*key, *of_first)])
    aggs = [F.max_by(whole, order).alias("w"), first.alias("first"), *(F.min_by(c, F.struct("src", "seq")).alias(c) for c in of_first)]
    if strict_updates:
        aggs.append(F.sort_array(F.collect_list(F.struct("src", "seq", "stamp"))).alias("sightings"))
    out = rows.groupBy(*key).agg(*aggs)
    more = ["sightings"] if strict_updates else []
    return out.select(*key, *of_first, "w.*", F.col("first.src").alias("first_src"), F.col("first.seq").alias("first_seq"), *more)


def union_tombstones(parts: list[DataFrame | None]) -> DataFrame:
    """The latest tombstone of each key; ties to the earliest source."""
    rows = _stacked([None if p is None else p.withColumn("seq", F.lit(0).cast("long")) for p in parts])
    return _latest(rows, ["kind", "key"], stamp_ms("at")).select("kind", "key", "at", "meta")


def prune_tombstones(tombstones: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Tombstones that are at most ``days`` old."""
    return tombstones.where(stamp_ms(F.lit(as_of)) - stamp_ms("at") <= days * 86_400_000)


def entity_stamp() -> Column:
    return first_stamp("updatedAt", "createdAt")


def relation_stamp() -> Column:
    return first_stamp(F.col("metadata")["updatedAt"], "createdAt", F.col("metadata")["createdAt"])


def unique_keys(edges: DataFrame) -> DataFrame:
    """Edge keys made unique: later holders of a key, by order of first sighting, get ~1, ~2, ... behind it."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("first_src", "first_seq")) - 1
    return edges.withColumn("key", F.when(place > 0, F.concat_ws("~", "key", place.cast("string"))).otherwise(F.col("key")))


def merge_graphs(sources: list[Graph | None]) -> Merged:
    """Merges copies in one pass; a missing copy keeps its place in the order.

    An entity falls to a tombstone of its time or later, a relation likewise; a relation that lacks an end is
    dead if either end has a tombstone, else it is returned as dangling with the first copy that held it.
    """
    tombs = union_tombstones([s and s.tombstones for s in sources])
    dead = lambda kind: tombs.where(F.col("kind") == kind).select(F.col("key").alias("dead_key"), stamp_ms("at").alias("dead_at"))
    nodes = _latest(_stacked([s and s.entities for s in sources]), ["id"], entity_stamp(), strict_updates=True)
    # a sighting counts as a replacement if it is later than all before it
    overtakes = F.aggregate(
        "sightings",
        F.struct(F.lit(None).cast("long").alias("top"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["top"], s["stamp"]).alias("top"), (a["n"] + F.when(s["stamp"] > a["top"], 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    )
    nodes = nodes.withColumn("replaced", overtakes).join(dead("entities"), F.col("id") == F.col("dead_key"), "left")
    nodes = nodes.withColumn("killed", F.coalesce(F.col("dead_at") >= F.col("stamp"), F.lit(False)))
    live = nodes.where("not killed")

    sighted = _stacked([s and s.relations for s in sources]).withColumn("type", F.coalesce("type", F.lit("")))
    edges = _latest(sighted, ["from", "type", "to"], relation_stamp(), of_first=("key",))
    edges = unique_keys(edges).join(dead("relations"), relation_key("from", "type", "to") == F.col("dead_key"), "left")
    edges = edges.withColumn("killed", F.coalesce(F.col("dead_at") >= F.col("stamp"), F.lit(False))).drop("dead_key", "dead_at")
    lives = live.select("id", F.lit(True).alias("lives"), F.lit(False).alias("died"))
    gone = tombs.where("kind = 'entities'").select(F.col("key").alias("id"), F.lit(False).alias("lives"), F.lit(True).alias("died"))
    known = lives.unionByName(gone).groupBy("id").agg(F.max("lives").alias("lives"), F.max("died").alias("died"))
    for side in ("from", "to"):
        edges = edges.join(known.select(F.col("id").alias(side), F.col("lives").alias(f"{side}_lives"), F.col("died").alias(f"{side}_died")), side, "left")
    both, died = F.col("from_lives") & F.col("to_lives"), F.coalesce("from_died", F.lit(False)) | F.coalesce("to_died", F.lit(False))
    fate = F.when(F.col("killed"), "tombstoned").when(F.coalesce(both, F.lit(False)), "live").when(died, "tombstoned").otherwise("dangling")
    edges = edges.withColumn("fate", fate)

    node_columns = next(s for s in sources if s).entities.columns
    edge_columns = next(s for s in sources if s).relations.columns
    graph = Graph(live.select(*node_columns), edges.where("fate = 'live'").select(*edge_columns), tombs)
    counts = nodes.agg(F.coalesce(F.sum("replaced"), F.lit(0)).alias("replaced"), F.count_if("killed").alias("entitiesTombstoned"))
    counts = counts.crossJoin(
        edges.agg(F.count_if(F.col("fate") == "tombstoned").alias("relationsTombstoned"), F.count_if(F.col("fate") == "dangling").alias("dangling"))
    )
    return Merged(graph, edges.where("fate = 'dangling'").select(*edge_columns, F.col("first_src").alias("origin")), counts)


def drop_orphan_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations both of whose ends exist."""
    ids = entities.select("id")
    return relations.join(ids, relations["from"] == ids["id"], "left_semi").join(ids, relations["to"] == ids["id"], "left_semi")


def restore(entities: DataFrame, relations: DataFrame, new_entities: DataFrame, new_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds entities whose ids are new, then relations whose ends exist and whose keys are new; nothing is stamped."""
    nodes = entities.unionByName(new_entities.dropDuplicates(["id"]).join(entities.select("id"), "id", "left_anti"), allowMissingColumns=True)
    fresh = drop_orphan_edges(nodes, new_relations).join(relations.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return nodes, relations.unionByName(fresh, allowMissingColumns=True)


def reload(live: Graph, sources: list[Graph | None], as_of: str, days: int = 90) -> tuple[Merged, DataFrame]:
    """The live graph as source 0 merged with what lies on disk, old tombstones pruned, and what came and went."""
    merged = merge_graphs([live, *sources])
    merged.graph.tombstones = prune_tombstones(merged.graph.tombstones, as_of, days)
    old, new = live.entities.select("id"), merged.graph.entities.select("id")
    added = new.join(old, "id", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    removed = old.join(new, "id", "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    return merged, added.crossJoin(removed).crossJoin(merged.stats)
