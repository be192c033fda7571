"""The registered queries of this subpackage: each operator over its whole table, under its contract's columns.

What they give for nulls, empty and long texts, repeated rows, empty tables and clashing names is said at each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, quality, toxicity, warc
from .common import table
from .fingerprints import with_edits
from .html_text import extract
from .lm_scoring import score_held_out
from .near_dup import near_duplicates
from .token_counts import count_tokens


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by models of the labels that are not held out (``toxicity.score``)."""
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page (``html_text.extract``)."""
    return extract(table(spark, sf_dir, "pages"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, out of the archives (``warc.write``, ``warc.read``)."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness (``fingerprints.with_edits``)."""
    return with_edits(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base score and score of every document by a model of those not held out (``lm_scoring.score``)."""
    return score_held_out(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document, and whether it is contaminated (``decontaminate.hits``)."""
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document by the public 32k pieces (``token_counts.count_tokens``)."""
    import public_tokenizers  # only this query needs the vocabulary files

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, on four-word shingles (``near_dup.near_duplicates``)."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (``mixing.mix``)."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labels that are not held out (``quality.score``)."""
    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_html_text,
        op3_warc_segments,
        op4_weighted_fingerprints,
        op5_lm_scoring,
        op6_decontamination,
        op7_token_counts,
        op8_near_duplicates,
        op9_mixing,
        op10_quality,
    )
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op3_warc_segments": warc.ORACLE, "op6_decontamination": decontaminate.ORACLE}
