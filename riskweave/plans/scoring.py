"""Scoring plan: a fixed-weight standardised linear scorer over the documents (the
transparent, SQL-checkable twin of the tree model), the client table (unlabelled
documents, positioned by key) and requests derived from the events table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.clean import with_position
from riskweave.operators.explain import linear_contributions
from riskweave.plans import entities as E
from riskweave.plans import roles
from riskweave.sources.tables import read_table

KEY = E.KEY
LIN_FEATURES = list(E.DOC_NUMERIC)
LIN_WEIGHTS = [(-1) ** k / (k + 1) for k in range(len(LIN_FEATURES))]
DECISION_THRESHOLD = 0.3
WATERFALL_TOP = 15
LOCAL_POSITIONS = (1, 24)


def linear_long(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    docs = roles.documents_entity(spark, d)
    return linear_contributions(docs, KEY, LIN_FEATURES, LIN_WEIGHTS)


def linear_stats(spark: SparkSession, d: str) -> dict:
    docs = roles.documents_entity(spark, d)
    row = docs.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(LIN_FEATURES)],
                   *[F.stddev_samp(c).alias(f"s{k}") for k, c in enumerate(LIN_FEATURES)]).first()
    return row.asDict()


def with_linear_score(df: DataFrame, stats: dict) -> DataFrame:
    """phi_<feature> columns, margin (= sum of phi, base 0) and proba = sigmoid."""
    phis = {}
    for k, (c, w) in enumerate(zip(LIN_FEATURES, LIN_WEIGHTS)):
        m, s = stats[f"m{k}"], stats[f"s{k}"]
        phis[f"phi_{c}"] = F.lit(float(w)) * (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
    out = df.withColumns(phis)
    margin = reduce(add, [F.col(p) for p in phis])
    out = out.withColumn("margin", margin)
    return out.withColumn("proba", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))))


def prod_clients(spark: SparkSession, d: str) -> DataFrame:
    """Clients to score: unlabelled documents restricted to the model's features
    (SRC5), with their 1-based position in key order."""
    docs = roles.documents_entity(spark, d)
    prod = docs.where(F.col(E.LABEL).isNull()).select(KEY, *LIN_FEATURES)
    return with_position(prod, KEY)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Request ids derived from the events table: integers in and out of range,
    zero and negatives, integers too large for bigint, decimals and words."""
    e = read_table(spark, d, "events")
    uid, et = F.col("user_id"), F.col("event_type")
    raw = (F.when(et == "click", uid.cast("string"))
           .when(et == "view", (-uid).cast("string"))
           .when(et == "error", F.concat(uid.cast("string"), F.when(
               F.col("event_id") % 2 == 0, F.lit("0" * 20)).otherwise(F.lit(".5"))))
           .when(et == "purchase", (uid + 1000000).cast("string"))
           .otherwise(et))
    return e.select(F.col("event_id").alias("request_no"), raw.alias("raw"))


REQUEST_SCHEMA = "request_no BIGINT, raw STRING"
