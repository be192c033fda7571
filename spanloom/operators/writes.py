"""Writes as copy-on-write transformations: each takes tables and returns new ones."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import is_uuid7, mint_uuid7, normalize_text, overlay, relation_key, truncate
from ..plans import SUPERSEDED_BY, TOMBSTONES
from ..sources.shared import small, work_dir, written
from .dedup import Matcher, NameMatcher
from .graph import degree
from .ontology import Catalog, isa_violations, unknown_classes


class Rejected(ValueError):
    """A write that the checks refuse, with the rows that are at fault."""


def _refuse(rows: DataFrame, why: str) -> None:
    bad = [r[0] for r in rows.select(rows.columns[0]).limit(5).collect()]
    if bad:
        raise Rejected(f"{why}: {', '.join(map(str, bad))}")


# ---------------------------------------------------------------- entities


def put_entities(entities: DataFrame, new: DataFrame, now: str, stamp: Column | None = None, strict: bool = True, catalog: Catalog | None = None) -> DataFrame:
    """Upserts by id. new has one row an id (fold a batch first), in any subset of the columns of entities.

    Strict puts need a stamp, UUIDv7 ids (a missing one is minted) and, with a catalogue, classes that it has. They set
    createdAt, updatedAt and validFrom, default layer, description and metadata, and count: the first writer stays
    createdBy, the last is lastConfirmedBy, every later put adds a confirmation. Trusted puts (strict=False) stamp
    nothing. With a catalogue no put may name a class beside an entityType that is not below it. Fields that a
    put leaves null keep their old values. Only rows that a put touches are joined; the others pass by.
    """
    if catalog:
        check_classes(new, catalog, strict)
    if strict:
        if stamp is None:
            raise Rejected("a strict put needs provenance")
        has = lambda c, kind="string": F.col(c) if c in new.columns else F.lit(None).cast(kind)
        minted = mint_uuid7(F.to_timestamp(F.lit(now)), has("name"), has("entityType"), has("seq", "long"))
        new = new.withColumn("id", F.coalesce(F.nullif(has("id"), F.lit("")), minted))
        _refuse(new.where(~is_uuid7("id")).select("id"), "ids that are no UUIDv7")
        made = F.coalesce(has("createdAt"), F.lit(now))
        meta = F.coalesce(F.col("metadata"), _empty()) if "metadata" in new.columns else _empty()
        defaults = {"layer": F.coalesce(has("layer"), F.lit("evidence")), "description": F.coalesce(has("description"), F.lit("")), "metadata": meta}
        new = new.withColumns({"createdAt": made, "updatedAt": F.lit(now), "validFrom": F.coalesce(has("validFrom"), made), **defaults})
    columns, ids = entities.columns, small(new.select("id"))
    old = entities.join(ids, "id", "left_semi").select(F.col("id").alias("_id"), F.struct(*columns).alias("o"))
    joined = new.select(F.struct(*new.columns).alias("n"), F.col("id").alias("_nid")).join(old, F.col("_nid") == F.col("_id"), "left")
    out = [(F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns else F.col(f"o.{c}")).alias(c) for c in columns]
    put = joined.select(*out, F.col("_id").isNotNull().alias("_had"))
    if strict:
        first = F.coalesce("provenance.createdBy", stamp)
        times = F.when(F.col("_had"), F.coalesce("provenance.confirmationCount", F.lit(0)) + 1).otherwise(F.lit(1)).cast("bigint")
        put = put.withColumn("provenance", F.struct(first.alias("createdBy"), stamp.alias("lastConfirmedBy"), times.alias("confirmationCount")))
    return entities.join(ids, "id", "left_anti").select(*columns).unionByName(put.select(*columns))


def check_classes(new: DataFrame, catalog: Catalog, strict: bool = True) -> None:
    """Refuses classes that a catalogue does not have (strict), and an ontologyClass that is no ancestor of the entityType."""
    if not {"entityType", "ontologyClass"} <= set(new.columns):
        new = new.withColumns({c: F.lit(None).cast("string") for c in ("entityType", "ontologyClass") if c not in new.columns})
    table, named = catalog.table(new.sparkSession), F.coalesce("entityType", "ontologyClass")
    if strict:
        _refuse(unknown_classes(new, table).select(named), "classes that the ontology does not have")
    bad = isa_violations(new, table, catalog.ancestors(new.sparkSession))
    _refuse(bad.select(F.concat_ws(" as ", "entityType", "ontologyClass")), "classes that are no ancestors of the entity type")


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def supersede(entities: DataFrame, relations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closes what new entities supersede. new is what was put; ids that were there before change nothing.

    The target must exist and must have no successor yet, nor two in one batch; its end is the successor's
    validFrom, and an edge SUPERSEDED_BY leads from it to the successor.
    """
    links = new.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("old"), F.col("id").alias("next"), F.col("validFrom").alias("at"))
    _refuse(links.join(entities.select(F.col("id").alias("old")), "old", "left_anti"), "superseded ids that do not exist")
    taken = relations.where(F.col("type") == SUPERSEDED_BY).select(F.col("from").alias("old"))
    _refuse(links.join(taken, "old", "left_semi"), "ids that have a successor")
    _refuse(links.groupBy("old").count().where("count > 1"), "ids with two successors in one batch")
    closed = entities.join(links, entities["id"] == links["old"], "left")
    closed = closed.withColumns({"validUntil": F.coalesce("at", "validUntil"), "updatedAt": F.coalesce("at", "updatedAt")}).select(*entities.columns)
    edges = links.select(
        F.xxhash64("old", "next").alias("seq"),
        F.concat_ws("|", "old", "next", F.lit(SUPERSEDED_BY)).alias("key"),
        F.col("old").alias("from"),
        F.col("next").alias("to"),
        F.lit(SUPERSEDED_BY).alias("type"),
        F.col("at").alias("createdAt"),
    )
    return closed, relations.unionByName(edges, allowMissingColumns=True)


def delete_entities(entities: DataFrame, relations: DataFrame, tombstones: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drops entities and their edges and leaves entity tombstones; edges get none of their own. Unknown ids do nothing."""
    gone = small(ids.select("id").distinct())
    meta = F.struct(*(F.col("metadata")[c].alias(c) for c in ("project", "team", "domain")))
    fresh = entities.join(gone, "id", "left_semi").select(F.lit("entities").alias("kind"), F.col("id").alias("key"), F.lit(now).alias("at"), meta.alias("meta"))
    left = relations.join(gone.withColumnRenamed("id", "from"), "from", "left_anti").join(gone.withColumnRenamed("id", "to"), "to", "left_anti")
    return entities.join(gone, "id", "left_anti").select(*entities.columns), left.select(*relations.columns), _latest(tombstones, fresh)


def _latest(tombstones: DataFrame, fresh: DataFrame) -> DataFrame:
    return tombstones.join(fresh.select("kind", "key"), ["kind", "key"], "left_anti").select(*tombstones.columns).unionByName(fresh.select(*tombstones.columns))


def merge_attributes(entities: DataFrame, id_: str, changes: dict[str, Column]) -> DataFrame:
    """Replaces top-level attributes of one entity, metadata as a whole; an unknown id is an error."""
    if entities.where(F.col("id") == id_).isEmpty():
        raise Rejected(f"no entity {id_}")
    return entities.withColumns({c: F.when(F.col("id") == id_, v).otherwise(F.col(c)) for c, v in changes.items()})


# ---------------------------------------------------------------- relations


def add_relations(
    entities: DataFrame, relations: DataFrame, tombstones: DataFrame, new: DataFrame, now: str, self_loops: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Upserts by (from, type, to). The first record keeps its attributes, metadata is overlaid in order of seq, and
    the first createdAt in metadata stays. Ends must exist; edges to oneself are refused unless asked for.
    A missing key is minted of the triple. A relation that had a tombstone is alive again, stamped with its time. Only
    the triples of new are folded; other relations pass by.
    """
    if not self_loops:
        _refuse(new.where(F.col("from") == F.col("to")).select("from"), "relations of an entity to itself")
    ids = entities.select("id")
    for side in ("from", "to"):
        _refuse(new.join(ids.withColumnRenamed("id", side), side, "left_anti").select(side), f"'{side}' ends that do not exist")
    triple = ["from", "type", "to"]
    dead = tombstones.where("kind = 'relations'").select(F.col("key").alias("_dead"))
    revived = new.join(dead, relation_key(*triple) == F.col("_dead"), "left")
    stamped = overlay(F.col("metadata"), F.create_map(F.lit("updatedAt"), F.lit(now)))
    minted = F.concat_ws("|", "from", "to", "type")
    revived = revived.withColumns(
        {
            "metadata": F.when(F.col("_dead").isNotNull(), stamped).otherwise(F.col("metadata")),
            "key": F.coalesce(F.col("key"), minted) if "key" in new.columns else minted,
        }
    )
    touched = small(new.select(*triple).distinct())
    both = relations.join(touched, triple, "left_semi").withColumn("_turn", F.lit(0)).unionByName(
        revived.drop("_dead").withColumn("_turn", F.lit(1)), allowMissingColumns=True
    )
    after = relations.join(touched, triple, "left_anti").select(*relations.columns).unionByName(_folded(both, relations.columns))
    alive = new.select(relation_key(*triple).alias("key"), F.lit("relations").alias("kind"))
    return after, tombstones.join(alive, ["kind", "key"], "left_anti").select(*tombstones.columns)


def _folded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a triple of rows with _turn; those of one triple are few, the fold is an expression over them."""
    whole = F.struct("_turn", "seq", *(c for c in columns if c != "seq"))
    # metadata is a map and has no order, so the order is spelled out
    sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    order = lambda a, b: F.when(a["_turn"] != b["_turn"], sign(a["_turn"], b["_turn"])).otherwise(sign(a["seq"], b["seq"]))
    group = rows.groupBy("from", "type", "to").agg(F.array_sort(F.collect_list(whole), order).alias("w"))
    meta = F.aggregate("w", _empty(), lambda a, x: overlay(a, x["metadata"]))
    made = F.get(F.filter(F.transform("w", lambda x: x["metadata"]["createdAt"]), lambda x: x.isNotNull()), F.lit(0))
    meta = F.when(made.isNotNull(), overlay(meta, F.create_map(F.lit("createdAt"), made))).otherwise(meta)
    first = F.get("w", F.lit(0))
    return group.withColumn("metadata", meta).select(*("metadata" if c == "metadata" else first[c].alias(c) for c in columns))


def remove_relations(relations: DataFrame, tombstones: DataFrame, keys: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Drops relations by key and leaves tombstones of their triples; unknown keys do nothing."""
    gone = small(keys.select("key").distinct())
    empty = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("project", "team", "domain")))
    fresh = relations.join(gone, "key", "left_semi").select(
        F.lit("relations").alias("kind"), relation_key("from", "type", "to").alias("key"), F.lit(now).alias("at"), empty.alias("meta")
    )
    return relations.join(gone, "key", "left_anti").select(*relations.columns), _latest(tombstones, fresh)


def batch(
    entities: DataFrame,
    relations: DataFrame,
    tombstones: DataFrame,
    now: str,
    puts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    adds: DataFrame | None = None,
    removes: DataFrame | None = None,
    catalog: Catalog | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Puts (trusted), deletes, added relations, and relations removed by triple, all or none: checks come first."""
    if puts is not None:
        last = puts.groupBy("id").agg(F.max_by(F.struct(*puts.columns), "seq").alias("w")).select("w.*")
        entities = put_entities(entities, last, now, strict=False, catalog=catalog)
    if deletes is not None:
        entities, relations, tombstones = delete_entities(entities, relations, tombstones, deletes, now)
    if adds is not None:
        relations, tombstones = add_relations(entities, relations, tombstones, adds, now)
    if removes is not None:
        first = relations.join(small(removes.select("from", "type", "to").distinct()), ["from", "type", "to"]).groupBy("from", "type", "to").agg(
            F.min_by("key", "seq").alias("key")
        )
        relations, tombstones = remove_relations(relations, tombstones, first, now)
    return entities, relations, tombstones


# ---------------------------------------------------------------- merging duplicates


def rewired(relations: DataFrame, survivors: DataFrame) -> DataFrame:
    """Relations with duplicates' ends moved to their survivors (dup, survivor); loops that this makes are dropped,
    edges that now agree are one."""
    ends = relations
    for side in ("from", "to"):
        there = small(survivors.select(F.col("dup").alias(side), F.col("survivor").alias(f"_{side}")))
        ends = ends.join(there, side, "left")
    moved = F.col("_from").isNotNull() | F.col("_to").isNotNull()
    ends = ends.withColumns({"_turn": moved.cast("int"), "from": F.coalesce("_from", "from"), "to": F.coalesce("_to", "to")})
    return _folded(ends.where(~((F.col("_turn") == 1) & (F.col("from") == F.col("to")))), relations.columns)


def merge_entities(entities: DataFrame, relations: DataFrame, survivors: DataFrame, now: str, by: str = "", reason: str = "") -> tuple[DataFrame, DataFrame]:
    """Merges duplicates into survivors (dup, survivor), many groups at once.

    Duplicates are closed and point to their survivors by SUPERSEDED_BY; edges are rewired; the survivor's confirmations
    grow by the number of duplicates, its history by a record each, its segments by theirs.
    """
    _refuse(survivors.where("dup = survivor").select("dup"), "survivors among their duplicates")
    _refuse(survivors.groupBy("dup").count().where("count > 1"), "duplicates with two survivors")
    _refuse(survivors.join(survivors.select(F.col("survivor").alias("dup")), "dup", "left_semi").select("dup"), "duplicates that are survivors")
    for c in ("dup", "survivor"):
        _refuse(survivors.select(c).join(entities.select(F.col("id").alias(c)), c, "left_anti"), "ids that do not exist")
    taken = relations.where(F.col("type") == SUPERSEDED_BY).select(F.col("from").alias("dup"))
    _refuse(survivors.join(taken, "dup", "left_semi").select("dup"), "duplicates that have a successor")
    record = F.struct(F.col("dup").alias("mergedId"), F.lit(now).alias("mergedAt"), F.lit(by).alias("mergedBy"), F.lit(reason).alias("mergedReason"))
    parts = survivors.join(entities.select(F.col("id").alias("dup"), "seq", F.col("descriptionSegments").alias("_s")), "dup")
    gained = parts.groupBy("survivor").agg(
        F.count(F.lit(1)).alias("_n"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", record.alias("r")))), lambda x: x["r"]).alias("_h"),
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", "_s"))),
                lambda x: F.coalesce(x["_s"], F.array().cast(entities.schema["descriptionSegments"].dataType)),
            )
        ).alias("_more"),
    )
    dups = survivors.select("dup", F.lit(True).alias("_dup"))
    out = entities.join(dups, entities["id"] == dups["dup"], "left").join(gained, entities["id"] == gained["survivor"], "left")
    count = F.coalesce("provenance.confirmationCount", F.lit(1)) + F.col("_n")
    prov = F.when(F.col("_n").isNull(), F.col("provenance")).otherwise(
        F.struct(
            F.col("provenance.createdBy").alias("createdBy"),
            F.col("provenance.lastConfirmedBy").alias("lastConfirmedBy"),
            count.cast("bigint").alias("confirmationCount"),
        )
    )
    join = lambda c, more: F.when(F.col(more).isNull(), F.col(c)).otherwise(F.concat(F.coalesce(F.col(c), F.array().cast(entities.schema[c].dataType)), F.col(more)))
    closed = F.when(F.col("_dup"), F.lit(now))
    out = out.withColumns(
        {
            "provenance": prov,
            "resolutionHistory": join("resolutionHistory", "_h"),
            "descriptionSegments": join("descriptionSegments", "_more"),
            "validUntil": F.coalesce(closed, "validUntil"),
            "updatedAt": F.coalesce(closed, "updatedAt"),
        }
    )
    edges = survivors.select(
        F.xxhash64("dup").alias("seq"),
        F.concat_ws("|", "dup", "survivor", F.lit(SUPERSEDED_BY)).alias("key"),
        F.col("dup").alias("from"),
        F.col("survivor").alias("to"),
        F.lit(SUPERSEDED_BY).alias("type"),
        F.lit(now).alias("createdAt"),
        F.lit(now).alias("validFrom"),
    )
    return out.select(*entities.columns), rewired(relations, survivors).unionByName(edges, allowMissingColumns=True)


def fold_segments(segments: Column) -> Column:
    """Segments with equal text (white space aside) as one, the later ones as confirmations of the first.

    Texts are normalised once each; confirmations that segments came with do not count.
    """
    texts = F.transform(segments, lambda s: normalize_text(s["text"]))
    mark = lambda s: F.struct(*(s[c].alias(c) for c in ("provider", "model", "runId", "timestamp")))

    def one(pairs: Column) -> Column:
        def folded(text: Column) -> Column:
            same = F.filter(pairs, lambda p: p["t"] == text)
            return F.get(same, F.lit(0))["s"].withField("confirmations", F.transform(F.slice(same, 2, F.size(same)), lambda p: mark(p["s"])))

        return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["t"])), folded)

    pairs = F.arrays_zip(texts.alias("t"), segments.alias("s"))
    return F.element_at(F.transform(F.array(pairs), one), 1)


def fold_rows(segments: DataFrame, by: str, order: str) -> tuple[DataFrame, DataFrame]:
    """fold_segments() for segments that are rows: kept ones (by, order, confirmations: their number), and confirmations
    (first: the ``order`` of the kept one, then their own columns), a row each.

    Rows of one ``by`` fold whose texts are equal, white space aside, or all missing; the first by ``order`` is kept. Texts are
    known by their SHA-256, so they are not moved to be grouped, and an entity may have any number of segments.
    """
    keyed = segments.withColumn("_text", F.sha2(normalize_text("text").cast("binary"), 256))
    first = keyed.groupBy(by, "_text").agg(F.min(order).alias("first"), (F.count(F.lit(1)) - 1).alias("confirmations"))
    kept = first.select(F.col(by), F.col("first").alias(order), "confirmations")
    a, b = keyed.alias("a"), first.alias("b")
    rest = a.join(b, F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")) & F.col("a._text").eqNullSafe(F.col("b._text")) & (F.col(f"a.{order}") > F.col("b.first")))
    return kept, rest.select("b.first", *(F.col(f"a.{c}") for c in segments.columns))


# ---------------------------------------------------------------- resolution


@dataclass
class Resolution:
    """What a resolution planned or did: merges (class, dup, survivor, names, confidence), counts by class, and whether it was a trial."""

    merges: DataFrame
    counts: DataFrame
    dry_run: bool


def _ordinals(rows: DataFrame, by: str, chunk: int = 100_000) -> DataFrame:
    """rows with _place, from 0 by seq in each group of ``by``: chunks of the sequence are numbered apart, then shifted by
    how many rows stand in earlier ones, so no group is sorted in one task."""
    rows = rows.withColumn("_chunk", F.floor(F.col("seq") / chunk))
    sizes = rows.groupBy(by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(by, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(by, "_chunk").orderBy("seq", "id")) - 1
    return rows.withColumn("_at", place).join(sizes, [by, "_chunk"]).withColumn("_place", F.col("_at") + F.col("_before")).drop("_chunk", "_at", "_before")


def resolve_plan(
    entities: DataFrame,
    relations: DataFrame,
    classes: list[str],
    matcher: Matcher | None = None,
    batch_size: int = 30,
    threshold: float = 0.7,
    dry_run: bool = False,
) -> DataFrame:
    """(class, dup, dup_name, survivor, survivor_name, confidence): duplicates inside batches of each class, in insertion order.

    Any matcher does: by name, by vector, or one that asks a model. A subject takes its best candidate; of those with
    its name and description (200 characters) the least id. Of a pair that of the higher degree survives, the subject if equal. Every entity
    is in one merge at most: pairs are taken by subject, and one that meets an entity already taken is left out; a
    dry run takes nothing away, so it may name a pair from both sides. A last batch of one entity is skipped.
    """
    matcher = matcher or NameMatcher()
    kind = F.coalesce("ontologyClass", "entityType")
    rows = _ordinals(entities.where(kind.isin(*classes)).withColumn("_class", kind), "_class")
    rows = rows.withColumn("_batch", F.concat_ws("\u0000", "_class", F.floor(F.col("_place") / batch_size).cast("string")))
    pool = rows.withColumns({"entityType": F.col("_batch"), "ontologyClass": F.lit(None).cast("string")})
    pairs = matcher.pairs(pool, pool).where("id <> cand").select("id", "cand", F.col("score").alias("confidence")).where(F.col("confidence") >= threshold)
    subject = rows.select("id", "seq", "name", "_class", "_batch")
    text = truncate("description").alias("_text")
    target = rows.select(F.col("id").alias("cand"), F.col("seq").alias("cand_seq"), F.col("name").alias("cand_name"), text, "_batch")
    twins = target.groupBy("_batch", "cand_name", "_text").agg(F.sort_array(F.collect_list("cand")).alias("twins"))  # batch_size at most
    pairs = pairs.join(subject, "id").join(target.drop("_batch"), "cand").join(twins, ["_batch", "cand_name", "_text"])
    other = F.get(F.filter("twins", lambda x: x != F.col("id")), F.lit(0))
    pairs = pairs.select("_batch", "_class", "id", "seq", "name", "cand_seq", "cand_name", "confidence", other.alias("other"))
    deg = degree(entities, relations)
    pairs = pairs.join(deg.withColumnRenamed("degree", "d1"), "id").join(deg.select(F.col("id").alias("other"), F.col("degree").alias("d2")), "other")
    kinds = {"class": "_class", "dup": None, "dup_name": None, "survivor": None, "survivor_name": None, "confidence": None}

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        taken, asked, out = set(), set(), []
        for r in rows.sort_values(["seq", "confidence", "cand_seq"], ascending=[True, False, True]).itertuples(index=False):
            kind, subject, other = r[1], (r.id, r.name), (r.other, r.cand_name)
            if r.id in asked or r.id in taken or r.other in taken:
                continue
            survivor, dup = (other, subject) if r.d2 > r.d1 else (subject, other)
            asked.add(r.id)
            if not dry_run:
                taken |= {r.id, r.other}
            out.append((kind, *dup, *survivor, r.confidence))
        return pd.DataFrame(out, columns=list(kinds))

    # a batch's pairs: batch_size ** 2 at most
    pairs = pairs.select("_batch", "_class", "id", "seq", "name", "cand_seq", "cand_name", "confidence", "other", "d1", "d2")
    return pairs.groupBy("_batch").applyInPandas(take, "class string, dup string, dup_name string, survivor string, survivor_name string, confidence double")


def resolve_entities(
    entities: DataFrame, relations: DataFrame, classes: list[str], now: str, matcher: Matcher | None = None, dry_run: bool = False, by: str = "", **how
) -> tuple[DataFrame, DataFrame, Resolution]:
    """The tables with duplicates merged (as they were in a dry run), and what was done, with counts by class."""
    merges = resolve_plan(entities, relations, classes, matcher, dry_run=dry_run, **how)
    merges = written(merges, f"{work_dir(entities.sparkSession)}/merges")  # a matcher is asked once
    scanned = entities.where(F.coalesce("ontologyClass", "entityType").isin(*classes)).groupBy(F.coalesce("ontologyClass", "entityType").alias("class")).agg(
        F.count(F.lit(1)).alias("scanned")
    )
    counts = scanned.join(merges.groupBy("class").agg(F.count(F.lit(1)).alias("matches")), "class", "left").na.fill(0, ["matches"])
    if not dry_run:
        entities, relations = merge_entities(entities, relations, merges.select("dup", "survivor"), now, by, "resolved")
    return entities, relations, Resolution(merges, counts, dry_run)


def backfill(entities: DataFrame, valid_from: Column, stamp: Column) -> DataFrame:
    """Entities without validFrom get one and a provenance; others stay, so a second run changes nothing."""
    missing = F.col("validFrom").isNull()
    made = F.struct(stamp.alias("createdBy"), stamp.alias("lastConfirmedBy"), F.lit(1).cast("bigint").alias("confirmationCount"))
    return entities.withColumn("provenance", F.when(missing, F.coalesce("provenance", made)).otherwise(F.col("provenance"))).withColumn(
        "validFrom", F.coalesce("validFrom", valid_from)
    )


def reproject(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Mapped rows whose legacy ids are not stored yet."""
    known = entities.select(F.col("legacyId.system").alias("_sys"), F.col("legacyId.id").alias("_lid"))
    return rows.join(known, (rows["legacyId.system"] == known["_sys"]) & (rows["legacyId.id"] == known["_lid"]), "left_anti")


def aggregates_edges(owners: DataFrame, refs: str, owned: DataFrame, owner_id: str = "id", owned_legacy: str = "legacy") -> tuple[DataFrame, DataFrame]:
    """Edges from owners to what their list of legacy ids names, and the references that name nothing."""
    each = owners.select(F.col(owner_id).alias("from"), F.explode(refs).alias("ref")).distinct()
    met = each.join(owned.select(F.col(owned_legacy).alias("ref"), F.col("id").alias("to")), "ref", "left")
    return met.where(F.col("to").isNotNull()).select("from", "to", F.lit("aggregates").alias("type")), met.where(F.col("to").isNull()).select("from", "ref")


def empty_tombstones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TOMBSTONES)
