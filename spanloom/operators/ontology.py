"""The class catalogue: inheritance, ancestors, checks and rendering.

A catalogue is the content of a few files that are read on the driver; as a table it is a small dimension.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ROOTS, col, overlay
from ..plans import CLASSES
from ..sources.ontologies import ontology_order, read_ontology
from ..sources.shared import small, work_dir, written


@dataclass
class Catalog:
    """Classes by name. A class takes over relationships and properties of a parent that was loaded before it; its own win."""

    classes: dict[str, dict[str, Any]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def register(self, source: str, classes: dict[str, dict[str, Any]]) -> None:
        for name, spec in classes.items():
            parent = self.classes.get(spec.get("extends") or "", {})
            if name in self.classes:
                self.warnings.append(f"{name} of {source} replaces that of {self.classes[name]['source']}")
            joined = {k: {**parent.get(k, {}), **(spec.get(k) or {})} for k in ("relationships", "properties")}
            self.classes[name] = {**spec, **joined, "source": source, "load_ord": len(self.classes)}

    @classmethod
    def of(cls, files: dict[str, str], strict: bool = False) -> Catalog:
        """The classes of files (name -> text) in load order. A malformed one is left out with a warning, or refused."""
        out = cls()
        for name in ontology_order(files):
            try:
                source, classes = read_ontology(files[name])
            except ValueError as e:
                if strict or name == "upper.json":
                    raise
                out.warnings.append(f"{name} is left out: {e}")
                continue
            out.register("upper" if name == "upper.json" else source, classes)
        return out

    def reload(self, files: dict[str, str], strict: bool = False) -> None:
        """Takes over the classes of files at once; if they cannot be read, all stays as it was."""
        fresh = Catalog.of(files, strict)
        self.classes, self.warnings = fresh.classes, fresh.warnings

    def schema(self, name: str) -> dict[str, Any] | None:
        """A class with what it takes over from its parents; None if there is no such class."""
        found = self.classes.get(name)
        return found and {"name": name, **found}

    def entity_types(self, spark: SparkSession) -> DataFrame:
        """(name, description, source) of all classes, in load order."""
        rows = [(n, c.get("description") or "", c["source"], c["load_ord"]) for n, c in self.classes.items()]
        return spark.createDataFrame(rows, "name string, description string, source string, load_ord int").orderBy("load_ord").drop("load_ord")

    def parents(self, name: str) -> list[str]:
        """Ancestors, closest first, up to an unknown one; a cycle ends the list."""
        out, at = [], self.classes.get(name, {}).get("extends")
        while at and at in self.classes and at not in out and at != name:
            out.append(at)
            at = self.classes[at].get("extends")
        return out

    def below(self, ancestor: str) -> list[str]:
        return [c for c in self.classes if ancestor in self.parents(c)]

    def default_layer(self, name: str) -> str | None:
        return self.classes.get(name, {}).get("defaultLayer")

    def valid_relationships(self, name: str) -> dict[str, list[str]]:
        return self.classes.get(name, {}).get("relationships", {})

    def domains(self) -> list[str]:
        return list(dict.fromkeys(c["source"] for c in self.classes.values()))

    def prompt(self) -> str:
        lines = []
        for name, c in self.classes.items():
            extends = f" (extends {c['extends']})" if c.get("extends") else ""
            layer = f" [layer: {c['defaultLayer']}]" if c.get("defaultLayer") else ""
            rel = ", ".join(f"{k}->{'|'.join(v)}" for k, v in c["relationships"].items())
            lines.append(f"{name}{extends}: {c.get('description', '')}{layer}{f' [{rel}]' if rel else ''}")
        return "\n".join(lines)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for name, c in self.classes.items():
            props = {k: (p.get("type"), p.get("required"), p.get("enum"), p.get("format")) for k, p in c["properties"].items()}
            rows.append(
                (
                    name,
                    c["source"],
                    c["load_ord"],
                    c.get("extends"),
                    c.get("description"),
                    c.get("defaultLayer"),
                    c["relationships"],
                    props,
                    c.get("level"),
                    c.get("parent"),
                )
            )
        return spark.createDataFrame(rows, CLASSES)

    def ancestors(self, spark: SparkSession) -> DataFrame:
        """(name, ancestor, depth) of every class."""
        return spark.createDataFrame([(c, a, k) for c in self.classes for k, a in enumerate(self.parents(c), 1)], "name string, ancestor string, depth int")


def unknown_classes(entities: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entities whose class the catalogue does not have; a strict writer wants none."""
    named = entities.withColumn("_class", F.coalesce("ontologyClass", "entityType"))
    return named.join(small(catalog.select(F.col("name").alias("_class"))), "_class", "left_anti").select(*entities.columns)


def isa_violations(entities: DataFrame, catalog: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Entities of two known, different classes of which ontologyClass is no ancestor of entityType."""
    known = catalog.select("name")
    rows = entities.where(F.col("ontologyClass").isNotNull() & (F.col("ontologyClass") != F.col("entityType")))
    rows = rows.join(small(known), rows["entityType"] == known["name"], "left_semi").join(small(known), rows["ontologyClass"] == known["name"], "left_semi")
    above = small(ancestors.select(F.col("name").alias("entityType"), F.col("ancestor").alias("ontologyClass")))
    return rows.join(above, ["entityType", "ontologyClass"], "left_anti").select(*entities.columns)


def class_listing(catalog: DataFrame, display: dict[str, dict] | None = None, system: str = "") -> DataFrame:
    """Names; with display hints also level, parent and hint, and of ``coding`` the classes of its roots, first, where they are missing."""
    names = catalog.select("load_ord", "name")
    if display is None:
        return names.orderBy("load_ord").select("name")
    spark = catalog.sparkSession
    rows = catalog.select("load_ord", "name", "level", F.coalesce("parent", "extends").alias("parent"))
    if system == "coding":
        missing = spark.createDataFrame(
            [(k, c, 0, None) for k, c in enumerate(dict.fromkeys(ROOTS.values()), -9)], "load_ord int, name string, level int, parent string"
        )
        rows = missing.join(names.select("name"), "name", "left_anti").select(*rows.columns).unionByName(rows)
    hints = spark.createDataFrame([(k, h) for k, h in display.items()], "name string, display map<string,string>")
    return rows.join(F.broadcast(hints), "name", "left").orderBy("load_ord").select("name", "level", "parent", "display")


def inherited(classes: DataFrame, field: str = "properties") -> DataFrame:
    """(name, field) of classes (name, extends, load_ord and a map column) with what each takes over, as ``Catalog`` does it for a table
    of any size: a parent gives its own entries and those that it took over, if it was loaded before; the child's win."""
    own = classes.select("name", "extends", "load_ord", F.col(field).alias("bag"))
    level = own.select("name", F.col("extends").alias("up"), "load_ord", "bag")
    path, k = work_dir(classes.sparkSession), 0
    while True:
        level = written(level, f"{path}/{k}")
        parents = own.select(F.col("name").alias("up"), F.col("extends").alias("further"), F.col("load_ord").alias("up_ord"), F.col("bag").alias("more"))
        if level.join(parents, "up", "left_semi").isEmpty() or k > own.count():
            break
        joined = level.join(parents, "up", "left")
        earlier = F.col("up_ord") < F.col("load_ord")
        bag = F.when(earlier, overlay(F.col("more"), F.col("bag"))).otherwise(F.col("bag"))
        level = joined.select(
            "name",
            F.when(earlier, F.col("further")).alias("up"),
            F.when(earlier, F.col("up_ord")).otherwise(F.col("load_ord")).alias("load_ord"),
            bag.alias("bag"),
        )
        k += 1
    return level.select("name", F.col("bag").alias(field))


def closure(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(name, ancestor, depth) of a hierarchy table, level by level, each written; one of over ``most`` levels, or a cycle, is an error."""
    path = work_dir(edges.sparkSession)
    step = written(edges.select(col(child).alias("name"), col(parent).alias("ancestor")).where("ancestor is not null"), f"{path}/step")
    level, out, depth = step.withColumn("depth", F.lit(1)), step.withColumn("depth", F.lit(1)), 2
    up = step.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("next"))
    while True:
        level = written(level.join(up, "ancestor").select("name", F.col("next").alias("ancestor"), F.lit(depth).alias("depth")), f"{path}/{depth}")
        if level.isEmpty():
            return out
        if depth == most:
            raise ValueError(f"a hierarchy of over {most} levels, or a cycle")
        out, depth = out.unionByName(level), depth + 1
