"""From raw documents to packed training sequences: toxicity, near-duplicates, mixture, packing.

Every stage takes what its predecessor kept, written as Parquet and read again, and all but the last return the
columns of ``documents``. The mixture repeats a document's row as often as the mix takes it.

Defined cases: the stages' rules for nulls, empty and very long texts, ties, repeated rows and empty tables are their operators'; columns of
``documents`` that bear the name of a column an operator adds keep their own values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm import dedup, mixing, packing, toxicity
from pelagos.llm.common import materialise, small_batches, table


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs`` with its further columns set apart, so that none clashes with a column the operator adds."""
    own = {"doc_id", "text", "source"}
    apart = {c: f"_own_{n}" for n, c in enumerate(docs.columns) if c not in own}
    return stage(docs.withColumnsRenamed(apart)).select(*(F.col(f"`{apart.get(c, c)}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, lambda own: toxicity.score(own, model).where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _beside(docs, dedup.drop_near_duplicates)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return _beside(docs, lambda own: mixing.mix(own).where("repeats > 0").withColumn("_copy", copies))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's sequence and place."""
    return packing.pack(docs, with_ids=False)


def _small(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with whole texts in small batches, so that an executor's memory does not grow with their length."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("toxicity", _small(drop_toxic)), ("simhash", _small(drop_copies)), ("mixing", _small(mix_sources)), ("packing", _small(pack_sequences))]

#: SQL expresses neither the models nor the tokens; the tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
