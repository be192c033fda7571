"""From raw documents to a training mix: each stage reads what its predecessor wrote.

An empty table goes through all stages as an empty table; extra columns, whatever their names, stay until the last.

Toxic documents go, documents of low quality go, one document of each group of near-duplicates stays, documents
that hold benchmark passages go, and the rest is mixed to target weights. All stages but the last return the columns of
documents; none of them is expressible in SQL as a whole, so their tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, mixing, near_dup, quality, toxicity
from spanloom.llm.common import crc_mod, kept, table, work_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model of the labels, learnt on op1's folds, does not score 0.7 or more; null and empty texts have the
    score of a text without words. Repeated rows go or stay alike; no columns are added or lost."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 3) != 1)
    return toxicity.accepted(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model of the labels, learnt on op10's folds, scores 0.3 or more; else as the stage before."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 5) != 0)
    return quality.accepted(docs, model)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles, at 0.8 or more, the one of the least id; null ids come last. Documents without words
    all stay; rows equal in id and text are one row."""
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that benchmark windows do not contaminate, by op6's rule; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, by op9's weights; null and empty texts give none. A row a row, repeated ones too."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder and read again."""
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"{path}/{k}")
    return docs
