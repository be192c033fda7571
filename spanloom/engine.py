"""A graph store over three tables: the reads of the REST surface, and writes that make new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import parse_int
from .operators import graph as G
from .operators import ontology as O
from .operators import projections as P
from .operators import reads as R
from .operators import writes as W
from .operators.merge import Graph, Merged, reload, restore
from .plans import ENTITIES, RELATIONS, TOMBSTONES
from .sources import graphs as S
from .sources.shared import work_dir, written


class NotFound(LookupError):
    """What a request names is not there."""


class GraphStore:
    """Holds the current tables. Every write makes new ones and writes those that changed as a version of their own, so plans
    stay short and a version can be read again; snapshots are folders of Parquet.

    With a catalogue puts are checked against it. With a folder for changes every write appends what it did there, as
    (op, key, payload, ts), which ``streaming.apply_changes`` reads.
    """

    def __init__(
        self,
        spark: SparkSession,
        graph: Graph | None = None,
        as_of: str = "9999-12-31T00:00:00.000Z",
        catalog: O.Catalog | None = None,
        changes: str | None = None,
    ):
        self.spark, self.as_of, self.catalog, self.changes = spark, as_of, catalog, changes
        self.graph = graph or Graph(*(spark.createDataFrame([], s) for s in (ENTITIES, RELATIONS, TOMBSTONES)))
        self._path, self._version = None, 0

    @classmethod
    def load(cls, spark: SparkSession, path: str, as_of: str, exports: list[str] | None = None, **how) -> GraphStore:
        """Opens a snapshot, merged with exported files if there are any; old tombstones are pruned."""
        found = S.hydrate(spark, path, exports or [], as_of)
        return cls(spark, found.graph if found else None, as_of, **how)

    def save(self, path: str) -> None:
        S.save(self.graph, path)

    def export_files(self, path: str, known: list[str], files: int = 1) -> None:
        """Writes the buckets now, without waiting for a trigger."""
        S.export(self.graph, path, known, files)

    # reads

    def entities(self, limit: str | int | None = None, offset: str | int | None = None, **how) -> DataFrame:
        """A listing; limit and offset are numbers or the texts of a request."""
        limit, offset = parse_int(limit) or 0, max(parse_int(offset) or 0, 0)
        return P.entity_to_wire(R.list_entities(self.graph.entities, self.as_of, limit=limit, offset=offset, **how))

    def entity(self, id_: str) -> DataFrame:
        return P.entity_to_wire(R.get_entity(self.graph.entities, id_))

    def relations(self, **how) -> DataFrame:
        return P.relation_to_wire(R.find_relations(self.graph.relations, with_key=True, **how))

    def query(self, filters: dict[str, object], **how) -> DataFrame:
        return P.entity_to_wire(R.query(self.graph.entities, self.as_of, filters, **how))

    def search(self, q: str, limit: int = 20) -> DataFrame:
        return R.search(self.graph.entities, q, self.as_of, limit)

    def export(self) -> tuple[DataFrame, DataFrame]:
        """Everything, superseded entities too."""
        return P.entity_to_wire(self.graph.entities), P.relation_to_wire(self.graph.relations)

    def tombstones(self, kind: str = "entities") -> DataFrame:
        return S.tombstones_of(self.graph, kind)

    def stats(self) -> DataFrame:
        return P.stats_to_wire(G.stats(self.graph.entities, self.graph.relations))

    def connectivity(self) -> tuple[DataFrame, DataFrame]:
        return G.connectivity(self.graph.entities, self.graph.relations)

    def orphans(self) -> DataFrame:
        return P.entity_to_wire(G.orphans(self.graph.entities, self.graph.relations))

    def runs(self, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return R.runs(self.graph.entities, self.as_of, limit)

    def clusters(self, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
        return G.communities(self.graph.entities, self.graph.relations, **how)

    def chain(self, id_: str) -> DataFrame:
        return G.supersession_chain(self.graph.entities, self.graph.relations, id_)

    def classes(self, display: dict[str, dict] | None = None, system: str = "") -> DataFrame:
        return O.class_listing((self.catalog or O.Catalog()).table(self.spark), display, system)

    def entity_types(self) -> DataFrame:
        return (self.catalog or O.Catalog()).entity_types(self.spark)

    def schema(self, name: str) -> dict:
        found = (self.catalog or O.Catalog()).schema(name)
        if found is None:
            raise NotFound(f"no class {name}")
        return found

    # writes

    def _hold(self, graph: Graph) -> None:
        """Takes over the tables; those that changed are written."""
        self._path, self._version = self._path or work_dir(self.spark), self._version + 1
        parts = {}
        for name in ("entities", "relations", "tombstones"):
            new, old = getattr(graph, name), getattr(self.graph, name)
            parts[name] = old if new is old else written(new, f"{self._path}/v{self._version}/{name}")
        self.graph = Graph(**parts)

    def _tell(self, op: str, rows: DataFrame, now: str) -> None:
        """Appends a change a row; key is the first column, the payload the row as JSON."""
        if self.changes:
            out = rows.select(
                F.lit(op).alias("op"),
                F.col(f"`{rows.columns[0]}`").alias("key"),
                F.to_json(F.struct("*")).alias("payload"),
                F.to_timestamp(F.lit(now)).alias("ts"),
            )
            out.write.mode("append").parquet(self.changes)

    def put(self, new: DataFrame, now: str, stamp: Column | None = None, strict: bool = True) -> None:
        g = self.graph
        entities, relations = W.put_entities(g.entities, new, now, stamp, strict, self.catalog), g.relations
        if "supersedes" in new.columns:
            entities = written(entities, f"{work_dir(self.spark)}/put")
            fresh = entities.join(new.select("id"), "id", "left_semi") if "id" in new.columns else entities
            entities, relations = W.supersede(entities, relations, fresh.join(g.entities.select("id"), "id", "left_anti").select(*g.entities.columns))
        self._hold(Graph(entities, relations, g.tombstones))
        told = self.graph.entities.join(new.select("id"), "id", "left_semi") if "id" in new.columns else self.graph.entities.where(F.col("updatedAt") == now)
        self._tell("put", told.select("id", *(c for c in told.columns if c != "id")), now)

    def create(self, new: DataFrame, now: str) -> None:
        """A trusted put of rows that must have a name and a class."""
        named = F.coalesce("name", F.lit("")) != ""
        classed = F.coalesce(*(c for c in ("entityType", "ontologyClass") if c in new.columns), F.lit("")) != ""
        if not new.where(~(named & classed)).isEmpty():
            raise W.Rejected("an entity needs a name and an entityType")
        self.put(new, now, strict=False)

    def delete(self, ids: DataFrame, now: str) -> None:
        gone = self.graph.entities.join(ids.select("id"), "id", "left_semi").select("id")
        self._tell("delete", gone, now)
        self._hold(Graph(*W.delete_entities(self.graph.entities, self.graph.relations, self.graph.tombstones, ids, now)))

    def patch(self, id_: str, changes: dict[str, Column], now: str | None = None) -> None:
        if R.get_entity(self.graph.entities, id_).isEmpty():
            raise NotFound(f"no entity {id_}")
        self._hold(Graph(W.merge_attributes(self.graph.entities, id_, changes), self.graph.relations, self.graph.tombstones))
        if now:
            told = R.get_entity(self.graph.entities, id_)
            self._tell("put", told.select("id", *(c for c in told.columns if c != "id")), now)

    def relate(self, new: DataFrame, now: str, self_loops: bool = False) -> None:
        g = self.graph
        relations, tombs = W.add_relations(g.entities, g.relations, g.tombstones, new, now, self_loops)
        self._hold(Graph(g.entities, relations, tombs))
        told = self.graph.relations.join(new.select("from", "type", "to"), ["from", "type", "to"], "left_semi")
        self._tell("relate", told.select("key", *(c for c in told.columns if c != "key")), now)

    def unrelate(self, keys: DataFrame, now: str) -> None:
        g = self.graph
        missing = keys.select("key").join(g.relations.select("key"), "key", "left_anti").first()
        if missing:
            raise NotFound(f"no relation {missing[0]}")
        self._tell("unrelate", keys.select("key"), now)
        self._hold(Graph(g.entities, *W.remove_relations(g.relations, g.tombstones, keys, now)))

    def batch(self, now: str, **ops: DataFrame) -> None:
        g = self.graph
        self._hold(Graph(*W.batch(g.entities, g.relations, g.tombstones, now, catalog=self.catalog, **ops)))
        for op, told in (("puts", "put"), ("deletes", "delete")):
            if ops.get(op) is not None:
                rows = ops[op]
                self._tell(told, rows.select("id", *(c for c in rows.columns if c != "id")), now)

    def merge(self, survivors: DataFrame, now: str, by: str = "", reason: str = "") -> None:
        entities, relations = W.merge_entities(self.graph.entities, self.graph.relations, survivors, now, by, reason)
        self._hold(Graph(entities, relations, self.graph.tombstones))

    def resolve(self, classes: list[str], now: str, **how) -> W.Resolution:
        entities, relations, done = W.resolve_entities(self.graph.entities, self.graph.relations, classes, now, **how)
        if not done.dry_run:
            self._hold(Graph(entities, relations, self.graph.tombstones))
        return done

    def reload(self, sources: list[Graph | None]) -> DataFrame:
        merged: Merged
        merged, changes = reload(self.graph, sources, self.as_of)
        changes = written(changes, f"{work_dir(self.spark)}/changes")
        self._hold(merged.graph)
        return changes

    def reload_catalog(self, files: dict[str, str], strict: bool = False) -> None:
        """Takes over ontology files (name -> text) at once."""
        self.catalog = self.catalog or O.Catalog()
        self.catalog.reload(files, strict)

    def restore(self, entities: DataFrame, relations: DataFrame) -> None:
        self._hold(Graph(*restore(self.graph.entities, self.graph.relations, entities, relations), self.graph.tombstones))
