"""Queries of this subpackage: ``opN_<name>`` over the whole given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from riskweave.llm import (op1_mix, op2_pack, op3_dedup, op4_langid, op5_minhash, op6_html, op7_lm, op8_pii, op9_warc, op10_embed,
                           op11_fim, op12_codes, op13_toxic, sql)
from riskweave.llm.common import table

_OPERATORS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "op1_pfair_mix": (op1_mix.mix, "documents"),
    "op2_best_fit_pack": (op2_pack.pack_documents, "documents"),
    "op3_trie_dedup": (op3_dedup.exact_dedup, "documents"),
    "op4_language_id": (op4_langid.identify, "documents"),
    "op5_minhash_forest": (op5_minhash.near_dedup, "documents"),
    "op6_main_text": (op6_html.extract, "pages"),
    "op7_backoff_score": (op7_lm.score, "documents"),
    "op8_personal_data": (op8_pii.find, "documents"),
    "op9_warc": (op9_warc.round_trip, "pages"),
    "op10_embed_dedup": (op10_embed.near_links, "embeddings"),
    "op11_fim_assembly": (op11_fim.digests, "documents"),
    "op12_active_lloyd": (op12_codes.compress, "embeddings"),
}


def _query(operator: Callable[[DataFrame], DataFrame], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_toxic.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(*v) for k, v in _OPERATORS.items()} | {"op13_toxic_automata": _toxicity, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_pfair_mix": sql.OP1, "op3_trie_dedup": sql.OP3, "op5_minhash_forest": sql.OP5,
            "op7_backoff_score": sql.OP7, "op9_warc": sql.OP9, "op10_embed_dedup": sql.OP10,
            "op11_fim_assembly": sql.OP11, "op12_active_lloyd": sql.OP12}
