"""From raw documents to pieces for training: five stages, each written as a table that the next one reads.

Toxic documents go, one document of each group of near-duplicates stays, passages that repeat an earlier document's go,
sources are mixed to their weights (documents repeat or go as their source's budget asks), and texts become pieces.

Defined results: stages keep a row's other columns; a text of which nothing is left stays as an empty one; rows of an
empty table are none. Each stage documents how it treats nulls, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import mixing, near_dedup, pieces, repeats, toxicity
from stratum.llm.shared import small_batches, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.without_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repeats.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("source_mix", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can express neither the fitted classifier nor the piece lattice; tests check each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, n_pieces, ids_sha256, nbest_scores, decoded_sha256 for each document of the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
