"""The training-data pipeline: five stages over ``documents``, each the whole work of one
operator on what the stage before kept.

=================  =========================================================================
language           texts without a letter go, and those scoring below the learned languages (4)
exact              of equal texts the smallest doc_id stays (3)
near               one document of each group of near-duplicates stays (5, five-word shingles)
mix                the stream of whole rows at the target weights, in its order (1)
pack               every token piece with its sequence and place (2)
=================  =========================================================================

All stages but the last return the columns of ``documents``. ``mix`` repeats documents of sources
that are below their target, so a doc_id may come more than once in its result, and every
such row is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import op1_mix, op2_pack, op3_dedup, op4_langid, op5_minhash
from riskweave.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_pack.pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# Language ID and the MinHash forest have no SQL form; tests/llm/test_pipeline.py compares
# run() with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
