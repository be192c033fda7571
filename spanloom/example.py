"""An adapter from end to end, as a pattern to copy: texts become entities, matched ones supersede, others are added.

    python -m spanloom.example
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import GraphStore
from .functions import derive_name, mint_uuid7
from .operators.dedup import Ingested, IngestPipeline, LayeredDeduplicator, NameMatcher, SemanticMatcher
from .plans import ENTITIES

NOW = "2024-06-01T00:00:00.000Z"


def extract(texts: DataFrame) -> DataFrame:
    """An observation a text, named by its first line."""
    kinds = {f.name: f.dataType for f in texts.sparkSession.createDataFrame([], ENTITIES).schema}
    made = texts.select(
        mint_uuid7(F.to_timestamp(F.lit(NOW)), "text").alias("id"),
        F.col("seq").cast("long").alias("seq"),
        derive_name("text").alias("name"),
        F.col("text").alias("description"),
        F.lit("Observation").alias("entityType"),
    )
    return made.select(*((F.col(c) if c in made.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def run(spark: SparkSession, store: GraphStore, texts: DataFrame, ask=lambda prompt: '{"matches": []}') -> Ingested:
    """Ingests (seq, text) into a store: matched by name, then by what ask answers."""

    def put(new: DataFrame, entities: DataFrame, provenance: Column) -> tuple[DataFrame, DataFrame]:
        store.put(new, NOW, provenance)
        return store.graph.entities, store.graph.relations

    stamp = F.struct(*(F.lit(v).alias(c) for c, v in (("provider", "example"), ("model", "none"), ("runId", "run-1"), ("timestamp", NOW))))
    pipeline = IngestPipeline(extract, LayeredDeduplicator([NameMatcher(), SemanticMatcher(ask)]), put)
    return pipeline.ingest(texts, store.graph.entities, store.graph.relations, stamp)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[2]").getOrCreate()
    example = GraphStore(session, as_of=NOW)
    for round_ in ([(1, "cache is cold\nfirst seen today"), (2, "queue is full")], [(3, "Cache is cold\nseen again")]):
        run(session, example, session.createDataFrame(round_, "seq int, text string")).decisions.show(truncate=False)
    example.entities().show(truncate=False)
    session.stop()
