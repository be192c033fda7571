"""Bringing an online export into the graph: observations, then digests over them, then insights over those."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mint_uuid7
from ..plans import ENTITIES
from . import projections
from .writes import aggregates_edges, reproject


@dataclass
class Reprojection:
    """Tables with what was new, edges that were new, references that name nothing, and counts by kind."""

    entities: DataFrame
    relations: DataFrame
    warnings: DataFrame
    counts: DataFrame


def reproject_online(
    entities: DataFrame, relations: DataFrame, observations: DataFrame, digests: DataFrame, insights: DataFrame, stamp: Column, now: str
) -> Reprojection:
    """Idempotent by class and legacy id: rows that are stored already are left alone, so a second run writes nothing.

    Legacy ids stay as given, so lookups by them work; ids of the three tables may agree, as their classes differ. Entity
    ids derive from creation time, class and legacy id. An insight's digests and a digest's observations become
    ``aggregates`` edges; a reference to an unknown row is a warning.
    """
    kinds = {f.name: f.dataType for f in entities.sparkSession.createDataFrame([], ENTITIES).schema}
    sources = (
        ("Observation", projections.map_observations, observations),
        ("Digest", projections.map_digests, digests),
        ("Insight", projections.map_insights, insights),
    )
    every, counts = entities, None
    for kind, f, rows in sources:
        mapped = f(rows, stamp)
        fresh = reproject(mapped.dropDuplicates(["legacyId"]), entities.where(F.coalesce("ontologyClass", "entityType") == kind))
        time = F.coalesce(F.try_to_timestamp("createdAt"), F.timestamp_seconds(F.lit(0)))
        fresh = fresh.withColumns({"id": mint_uuid7(time, F.lit(kind), "legacyId.id"), "seq": F.pmod(F.xxhash64(F.lit(kind), "legacyId.id"), F.lit(2**62))})
        full = fresh.select(*((F.col(c) if c in fresh.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
        one = mapped.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("scanned")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("written")))
        counts = one if counts is None else counts.unionByName(one)
        every = every.unionByName(full)
    edges = warnings = None
    named = every.select("id", F.coalesce("ontologyClass", "entityType").alias("kind"), F.col("legacyId.id").alias("legacy"))
    for owner, refs, rows, owned in (("Digest", "observationIds", digests, "Observation"), ("Insight", "digestIds", insights, "Digest")):
        owners = rows.select(F.col("id").cast("string").alias("legacy"), F.col(refs).cast("array<string>").alias("refs"))
        owners = owners.join(named.where(F.col("kind") == owner).select("id", "legacy"), "legacy")
        found, missed = aggregates_edges(owners, "refs", named.where(F.col("kind") == owned))
        edges, warnings = (found, missed) if edges is None else (edges.unionByName(found), warnings.unionByName(missed))
    edges = edges.join(relations.select("from", "to", "type"), ["from", "to", "type"], "left_anti")
    edges = edges.select(
        F.pmod(F.xxhash64("from", "to"), F.lit(2**62)).alias("seq"),
        F.concat_ws("|", "from", "to", "type").alias("key"),
        "from",
        "to",
        "type",
        F.lit(now).alias("createdAt"),
    )
    return Reprojection(every, relations.unionByName(edges, allowMissingColumns=True), warnings, counts)


def convert_dump(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A legacy dump as nodes and edges: a node's key is its name, else its id; edges refer to keys and get keys b-rel-0, ..."""
    nodes = entities.withColumn("key", F.coalesce("name", "id"))
    edges = relations.select(F.concat(F.lit("b-rel-"), "seq").alias("key"), "from", "to", F.col("relationType").alias("type"), "seq")
    return nodes, edges
