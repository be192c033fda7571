"""Projections: wire shapes, typed views of legacy rows, and the mappers from source rows to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive_name, lenient_object, lenient_strings, overlay

_EPOCH = "1970-01-01T00:00:00.000Z"


def packed_provenance() -> Column:
    """The provenance of a row: as it is, or made of the stamps that older rows carry, null without a createdBy.

    A count that was given counts; else a lone createdBy is one confirmation, and a row with lastConfirmedBy has none."""
    times = F.coalesce("confirmationCount", F.when(F.col("lastConfirmedBy").isNull(), F.lit(1)).otherwise(F.lit(0))).cast("bigint")
    confirmed = F.coalesce("lastConfirmedBy", "createdBy")
    packed = F.when(F.col("createdBy").isNotNull(), F.struct(F.col("createdBy"), confirmed.alias("lastConfirmedBy"), times.alias("confirmationCount")))
    return F.coalesce("provenance", packed)


def entity_to_wire(entities: DataFrame) -> DataFrame:
    """The eight core fields and the class. Metadata holds the provenance as JSON, unless it has one of its own."""
    packed = packed_provenance()
    meta = F.coalesce("metadata", _pairs())
    own = F.when(packed.isNotNull() & F.col("metadata")["provenance"].isNull(), F.to_json(packed))
    return entities.select(
        "id",
        "name",
        "entityType",
        "layer",
        "description",
        "createdAt",
        "updatedAt",
        with_fields(meta, keep=True, provenance=own).alias("metadata"),
        "ontologyClass",
    )


def relation_to_wire(relations: DataFrame) -> DataFrame:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return relations.select(
        F.coalesce("key", F.concat_ws("|", "from", "to", "type")).alias("key"),
        "from",
        "to",
        "type",
        F.coalesce("metadata", empty).alias("metadata"),
        F.coalesce("createdAt", F.lit("")).alias("createdAt"),
    )


def stats_to_wire(stats: DataFrame) -> DataFrame:
    """Counts with zero for what is missing, and the epoch for a missing time."""
    kinds = dict(stats.dtypes)
    out = [F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in stats.columns if c != "lastUpdated"]
    last = F.coalesce("lastUpdated", F.lit(_EPOCH)) if "lastUpdated" in kinds else F.lit(_EPOCH)
    return stats.select(*out, last.alias("lastUpdated"))


# ---------------------------------------------------------------- entities as legacy rows


def _meta(field: str) -> Column:
    return F.col("metadata")[field]


def observation_to_legacy(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.coalesce("legacyId.id", "id").alias("id"),
        F.coalesce(_meta("summary"), _meta("content"), F.col("description")).alias("content"),
        F.coalesce(_meta("agent"), F.lit("unknown")).alias("agent"),
        F.coalesce(_meta("project"), F.lit("unknown")).alias("project"),
        F.coalesce(_meta("quality"), F.lit("normal")).alias("quality"),
        F.coalesce(_meta("createdAt"), F.col("validFrom"), F.lit("")).alias("createdAt"),
    )


def digest_to_legacy(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.coalesce("legacyId.id", "id").alias("id"),
        F.coalesce(_meta("date"), F.lit("")).alias("date"),
        F.coalesce(_meta("theme"), F.col("name")).alias("theme"),
        F.coalesce(_meta("summary"), F.col("description")).alias("summary"),
        lenient_strings(_meta("observationIds")).alias("observationIds"),
        lenient_strings(_meta("agents")).alias("agents"),
        F.coalesce(_meta("quality"), F.lit("normal")).alias("quality"),
        F.coalesce(_meta("createdAt"), F.col("validFrom"), F.lit("")).alias("createdAt"),
    )


def insight_to_legacy(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.coalesce("legacyId.id", "id").alias("id"),
        F.coalesce(_meta("topic"), F.col("name")).alias("topic"),
        F.coalesce(_meta("summary"), F.col("description")).alias("summary"),
        F.coalesce(F.expr("try_cast(metadata['confidence'] AS double)"), F.lit(0.0)).alias("confidence"),
        lenient_strings(_meta("digestIds")).alias("digestIds"),
        F.coalesce(_meta("createdAt"), F.col("validFrom"), F.lit("")).alias("createdAt"),
    )


# ---------------------------------------------------------------- rows as entities


def _field(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of rows; null where rows have none of that name."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def _list_text(rows: DataFrame, name: str) -> Column:
    """A list of texts as a JSON array: of an array column, or of a JSON text; anything else is an empty one."""
    if dict(rows.dtypes).get(name, "").startswith("array"):
        texts = F.filter(F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    else:
        texts = lenient_strings(_field(rows, name))
    return F.to_json(texts)


def _pairs(**fields: Column) -> Column:
    """A map of those fields that are not null."""
    if not fields:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def with_fields(bag: Column, keep: bool = False, **fields: Column) -> Column:
    """A map with these fields, which win over its own: a null one takes the key out, or with keep leaves it."""
    if keep:
        return overlay(bag, _pairs(**fields))
    own = F.map_filter(bag, lambda k, _: ~k.isin(*fields))
    return F.map_concat(own, _pairs(**fields))


def _entity(rows: DataFrame, kind: str, layer: str, name: Column, created: Column, updated: Column, metadata: Column, stamp: Column) -> DataFrame:
    return rows.select(
        name.alias("name"),
        F.lit(kind).alias("entityType"),
        F.lit(kind).alias("ontologyClass"),
        F.lit(layer).alias("layer"),
        F.coalesce("summary", F.lit("")).alias("description"),
        created.alias("createdAt"),
        updated.alias("updatedAt"),
        created.alias("validFrom"),
        F.struct(F.lit("A").alias("system"), F.col("id").cast("string").alias("id")).alias("legacyId"),
        metadata.alias("metadata"),
        stamp.alias("createdBy"),
    )


def _or_empty(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(empty)"))


def map_observations(rows: DataFrame, stamp: Column) -> DataFrame:
    """Online observations: evidence, named by the first line of the summary (120 characters); llm and digestedAt only if set."""
    made = _field(rows, "createdAt")
    fields = {c: _field(rows, c) for c in ("project", "agent", "quality", "llm", "digestedAt")}
    meta = _pairs(subsystem=F.lit("online"), modifiedFiles=_list_text(rows, "modifiedFiles"), **fields)
    return _entity(rows, "Observation", "evidence", derive_name("summary"), made, made, meta, stamp)


def map_digests(rows: DataFrame, stamp: Column) -> DataFrame:
    """Online digests: evidence, named by their theme; made on their date, if they have no time."""
    made = F.coalesce(_field(rows, "createdAt"), _field(rows, "date"))
    lists = {c: _list_text(rows, c) for c in ("observationIds", "agents", "filesTouched")}
    meta = _pairs(subsystem=F.lit("online"), date=_field(rows, "date"), quality=_field(rows, "quality"), project=_field(rows, "project"), **lists)
    return _entity(rows, "Digest", "evidence", _or_empty(_field(rows, "theme")), made, made, meta, stamp)


def map_insights(rows: DataFrame, stamp: Column) -> DataFrame:
    """Online insights: patterns, named by their topic."""
    made = F.coalesce(_field(rows, "createdAt"), F.lit(_EPOCH))
    meta = _pairs(
        subsystem=F.lit("online"), digestIds=_list_text(rows, "digestIds"), confidence=_field(rows, "confidence", "double"), project=_field(rows, "project")
    )
    return _entity(rows, "Insight", "pattern", _or_empty(_field(rows, "topic")), made, made, meta, stamp)


def legacy_to_entity(rows: DataFrame, kind: str, stamp: Column) -> DataFrame:
    """Legacy observations, digests and insights; only observations are evidence.

    Names have 80 characters: of the theme or topic, else of the summary. Metadata is read leniently, and every column
    of the row wins over a field of that name in it, but for a missing project.
    """
    title = {"Observation": "summary", "Digest": "theme", "Insight": "topic"}[kind]
    named = F.coalesce(F.nullif(_field(rows, title), F.lit("")), _field(rows, "summary"), F.lit(""))
    name = F.coalesce(F.nullif(F.substring(named, 1, 80), F.lit("")), F.lit(f"(no {title})"))
    bag = F.col("metadata") if dict(rows.dtypes).get("metadata", "").startswith("map") else lenient_object(_field(rows, "metadata"))
    bag, made = F.coalesce(bag.cast("map<string,string>"), _pairs()), _field(rows, "created_at")
    fields = {"summary": _field(rows, "summary"), "createdAt": made}
    updated = made
    if kind == "Observation":
        fields |= {c: _field(rows, c) for c in ("agent", "session_id", "source_file", "content_hash", "quality", "digested_at")}
        fields["messages"] = F.to_json("messages") if dict(rows.dtypes).get("messages", "string") != "string" else _field(rows, "messages")
    else:
        fields["project"] = F.coalesce(_field(rows, "project"), bag["project"])
    if kind == "Digest":
        fields |= {c: _field(rows, c) for c in ("date", "theme", "quality")}
        fields |= {c: _list_text(rows, c) for c in ("observation_ids", "agents", "files_touched")}
    if kind == "Insight":
        last = _field(rows, "last_updated")
        updated = F.coalesce(F.nullif(last, F.lit("")), made)
        sure = F.coalesce(_field(rows, "confidence", "double").cast("double"), F.lit(0.8))
        fields |= {"topic": _field(rows, "topic"), "confidence": sure, "digest_ids": _list_text(rows, "digest_ids"), "last_updated": last}
    return _entity(rows, kind, "evidence" if kind == "Observation" else "pattern", name, made, updated, with_fields(bag, **fields), stamp)
