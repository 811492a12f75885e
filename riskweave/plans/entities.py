"""Labelled-entity views shared by the selection, metrics and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalar import hash_unit
from riskweave.plans import roles

KEY, LABEL = "SK_ID_CURR", "TARGET"
DOC_NUMERIC = ["N_CHARS", "N_SPACE_TOKENS", "N_LINES", "N_DIGITS", "N_UPPER", "N_AT", "N_EXCLAIM", "N_SPACES"]


def doc_features(spark: SparkSession, d: str) -> DataFrame:
    """All documents: key, TARGET (NULL = unlabelled), numeric measures, one-hot
    LANG / SOURCE with NULL indicators."""
    from riskweave.plans.features import fitted
    ent = roles.documents_entity(spark, d)
    spec = fitted(spark, d, "documents", ent, ["LANG", "SOURCE"], nan_column=True)
    return spec.transform(ent)


def labelled(df: DataFrame) -> DataFrame:
    return df.where(F.col(LABEL).isNotNull())


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """(key, TARGET, SCORE) for labelled documents; SCORE is a deterministic
    two-decimal score that leans towards the label (ties on purpose)."""
    ent = labelled(roles.documents_entity(spark, d)).select(KEY, LABEL)
    x = F.lit(0.6) * hash_unit(KEY, 1) + F.lit(0.4) * F.col(LABEL) * hash_unit(KEY, 2)
    return ent.withColumn("SCORE", F.floor(x * 100) / 100)
