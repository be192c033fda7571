"""Reads: filters, lookups, ranked search, counts and roll-ups. All are lazy; filters reach the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_ci, is_active

#: Rows that an unlimited listing returns at most; a feature of the listing, not of the engine.
LIST_CAP = 1000


def scan(entities: DataFrame, as_of: str, where: Column | None = None, superseded: bool = False) -> DataFrame:
    """All entities, or those that a condition admits, in insertion order."""
    rows = entities if where is None else entities.where(where)
    return (rows if superseded else rows.where(is_active(as_of))).orderBy("seq")


def get_entity(entities: DataFrame, id_: str) -> DataFrame:
    """The entity of an id, active or not."""
    return entities.where(F.col("id") == id_)


def of_class(name: str) -> Column:
    """The class by either of its two columns, exactly; subclasses are other classes."""
    return (F.col("entityType") == name) | F.coalesce(F.col("ontologyClass") == name, F.lit(False))


def find_by_class(entities: DataFrame, name: str, as_of: str, superseded: bool = False) -> DataFrame:
    return scan(entities, as_of, of_class(name), superseded)


def matches(entity_type: str | None = None, ontology_class: str | None = None, layer: str | None = None) -> Column:
    """Equality in each field that is given."""
    out = F.lit(True)
    for c, v in (("entityType", entity_type), ("ontologyClass", ontology_class), ("layer", layer)):
        if v is not None:
            out = out & F.coalesce(F.col(c) == v, F.lit(False))
    return out


def find_by_legacy_id(entities: DataFrame, system: str, id_: str, as_of: str, superseded: bool = False) -> DataFrame:
    """The first inserted entity of a legacy id."""
    return scan(entities, as_of, (F.col("legacyId.system") == system) & (F.col("legacyId.id") == id_), superseded).limit(1)


def find_by_content_hash(entities: DataFrame, agent: str, digest: str, as_of: str, ontology_class: str = "Observation", superseded: bool = False) -> DataFrame:
    found = of_class(ontology_class) & (F.col("metadata")["agent"] == agent) & (F.col("metadata")["content_hash"] == digest)
    return scan(entities, as_of, found, superseded).limit(1)


def repeated_content(rows: DataFrame, text: str, id_col: str) -> DataFrame:
    """(first, n) of each content that several rows hold: its least id and how many they are; contents are known by a hash."""
    hashed = rows.select(F.col(id_col).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first", "n")


def recent_by_agent(
    entities: DataFrame, agent: str, since: str, limit: int, as_of: str, ontology_class: str = "Observation", superseded: bool = False
) -> DataFrame:
    """Newest first; the bound is exclusive and compared as text; a limit of 0 or less gives all."""
    made = F.col("metadata")["createdAt"]
    rows = entities.where(of_class(ontology_class) & (F.col("metadata")["agent"] == agent) & (made > since))
    rows = (rows if superseded else rows.where(is_active(as_of))).orderBy(made.desc(), "seq")
    return rows.limit(limit) if limit > 0 else rows


def find_relations(relations: DataFrame, type_: str | None = None, from_: str | None = None, to: str | None = None, with_key: bool = False) -> DataFrame:
    """Relations by equality; their own validity never filters."""
    for c, v in (("type", type_), ("from", from_), ("to", to)):
        if v is not None:
            relations = relations.where(F.col(c) == v)
    return relations.orderBy("seq") if with_key else relations.orderBy("seq").drop("key")


def query(entities: DataFrame, as_of: str, filters: dict[str, object], ontology_class: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Active entities whose top-level fields equal the given values in value and kind; nested values equal nothing."""
    rows = find_by_class(entities, ontology_class, as_of) if ontology_class else scan(entities, as_of)
    kinds = dict(entities.dtypes)
    for field, value in filters.items():
        same = {"string": str, "boolean": bool, "bigint": int, "double": float}.get(kinds.get(field, ""))
        rows = rows.where(F.col(field) == value if same and type(value) is same else F.lit(False))
    return page(rows, limit, offset)


def page(rows: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    rows = rows.offset(offset) if offset > 0 else rows
    return rows.limit(limit) if limit > 0 else rows


def packed_run() -> Column:
    """The run that made a row, from its provenance or from the stamp that older rows carry."""
    return F.coalesce(F.col("provenance.createdBy.runId"), F.when(F.col("provenance").isNull(), F.col("createdBy.runId")))


def filtered(
    entities: DataFrame, as_of: str, ontology_class: str | None = None, run: str | None = None, tenant: Callable[[], Column | None] | None = None
) -> DataFrame:
    """Active entities by class, run and tenant, in insertion order. tenant makes a condition, or None for no filter."""
    rows = find_by_class(entities, ontology_class, as_of) if ontology_class else scan(entities, as_of)
    if run is not None:
        rows = rows.where(packed_run() == run)
    own = tenant() if tenant else None
    return rows if own is None else rows.where(own)


def list_entities(entities: DataFrame, as_of: str, limit: int = 0, offset: int = 0, **how) -> DataFrame:
    """A slice of ``filtered``. Without a limit more than LIST_CAP rows are cut to that."""
    return page(filtered(entities, as_of, **how), limit if limit > 0 else LIST_CAP, offset)


def search(entities: DataFrame, q: str, as_of: str, limit: int = 20) -> DataFrame:
    """Active entities that hold q: 3 points for the name, 2 for the description, 1 for the metadata as JSON."""
    score = sum(
        (F.when(contains_ci(c, q), F.lit(n)).otherwise(F.lit(0)) for c, n in (("name", 3), ("description", 2))),
        F.when(contains_ci(F.to_json("metadata"), q), F.lit(1)).otherwise(F.lit(0)),
    )
    rows = entities.where(F.lit(bool(q)) & is_active(as_of)).withColumn("score", score).where("score > 0")
    rows = rows.select(F.concat_ws(":", "layer", "id").alias("nodeId"), "id", "name", "score", "seq").orderBy(F.desc("score"), "seq").drop("seq")
    return rows.limit(limit) if limit > 0 else rows


def count_by_class(entities: DataFrame, name: str, as_of: str, superseded: bool = False, where: Column | None = None) -> DataFrame:
    rows = entities.where(of_class(name) if where is None else of_class(name) & where)
    return (rows if superseded else rows.where(is_active(as_of))).agg(F.count(F.lit(1)).alias("n"))


def counts_by_class(entities: DataFrame, as_of: str, superseded: bool = False) -> DataFrame:
    """Entities of each entityType."""
    rows = entities if superseded else entities.where(is_active(as_of))
    return rows.groupBy("entityType").agg(F.count(F.lit(1)).alias("n"))


def _last() -> Column:
    return F.max(F.when(F.col("createdAt") != "", F.col("createdAt"))).alias("last")


def last_modified(entities: DataFrame, name: str, as_of: str, superseded: bool = False) -> DataFrame:
    """The largest createdAt as text; empty ones do not count; null without any."""
    rows = entities.where(of_class(name))
    return (rows if superseded else rows.where(is_active(as_of))).agg(_last())


def last_modified_by_class(entities: DataFrame, as_of: str, superseded: bool = False) -> DataFrame:
    """The same of each entityType."""
    rows = entities if superseded else entities.where(is_active(as_of))
    return rows.groupBy("entityType").agg(_last())


def runs(entities: DataFrame, as_of: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Roll-up of active entities by run, newest first, and the totals over all runs."""
    by = F.coalesce(F.col("provenance.createdBy"), F.when(F.col("provenance").isNull(), F.col("createdBy")))
    rows = entities.where(is_active(as_of)).select("seq", by.alias("by")).where("by.runId is not null")
    out = rows.groupBy(F.col("by.runId").alias("runId")).agg(
        F.count(F.lit(1)).alias("entityCount"),
        F.min_by("by.provider", "seq").alias("provider"),
        F.min_by("by.model", "seq").alias("model"),
        F.min("by.timestamp").alias("firstSeen"),
        F.max("by.timestamp").alias("lastSeen"),
    )
    totals = out.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("entityCount"), F.lit(0)).alias("entitiesWithProvenance"))
    ranked = out.orderBy(F.desc_nulls_last("lastSeen"), "runId")
    return (ranked.limit(limit) if limit > 0 else ranked), totals


def layer_counts(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count_if(F.col("layer") == "evidence").alias("evidence"), F.count_if(F.col("layer") == "pattern").alias("pattern"))
