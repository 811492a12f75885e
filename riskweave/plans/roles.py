"""Role mapping: the reference's loan tables expressed over the given tables.

| role                      | table(s)                     |
|---------------------------|------------------------------|
| application (client)      | customer                     |
| bureau / bureau_balance   | orders / lineitem            |
| previous_application      | orders + per-order lineitem aggregate |
| installments_payments     | lineitem JOIN orders         |
| POS_CASH / credit_card    | events                       |
| labelled entity           | documents LEFT JOIN labels   |

Amounts are in thousands (``x / 1000``); day columns are signed day counts to a
reference date, as in the reference's relative ``DAYS_*`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalar import days_between
from riskweave.sources.tables import read_table

# Fixed values of the role mapping.
REF_DATE = "2002-01-01"          # day 0 for order / shipping dates
EVENT_REF_DATE = "2024-02-01"    # day 0 for event timestamps
SENTINEL_DAYS = -2557            # 1995-01-01: the "unknown date" marker (like 365243)
ACTIVE, CLOSED = "O", "F"        # bureau subsets on CREDIT_ACTIVE
APPROVED, REFUSED = "F", "P"     # previous-application subsets on NAME_CONTRACT_STATUS


def _days(col, ref=REF_DATE):
    return days_between(F.col(col), ref).cast("int")


def application(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("SK_ID_CURR"),
        F.col("c_mktsegment").alias("NAME_SEGMENT"),
        F.when(F.col("c_acctbal") >= 0, F.lit("Y")).otherwise(F.lit("N")).alias("FLAG_POSITIVE_BALANCE"),
        (F.col("c_acctbal") / 1000).alias("AMT_BALANCE"),
        F.col("c_nationkey").alias("NATION_CODE"),
    )


def bureau(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("SK_ID_BUREAU"),
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderstatus").alias("CREDIT_ACTIVE"),
        F.col("o_orderpriority").alias("CREDIT_TYPE"),
        (F.col("o_totalprice") / 1000).alias("AMT_CREDIT_SUM"),
        _days("o_orderdate").alias("DAYS_CREDIT"),
    )


def bureau_balance(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        F.col("l_linenumber").alias("MONTHS_BALANCE"),
        F.col("l_linestatus").alias("STATUS"),
        F.col("l_returnflag").alias("RETURN_FLAG"),
    )


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem at line grain with the columns both order-level chains need
    (bureau balance and previous-application amounts)."""
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        F.col("l_linenumber").alias("MONTHS_BALANCE"),
        F.col("l_linestatus").alias("STATUS"),
        F.col("l_returnflag").alias("RETURN_FLAG"),
        "l_extendedprice", "l_discount", "l_shipdate",
    )


def previous_columns(sentinel: int = SENTINEL_DAYS, ieee: bool = False) -> dict:
    """previous_application columns as expressions over ``orders LEFT JOIN per-order
    line aggregate`` (the table the bureau chain uses too); AMT_CREDIT and
    AMT_GOODS_PRICE come from the line aggregate as they are. The 'unknown date'
    marker becomes NULL and the ratio follows the zero-denominator policy."""
    from riskweave.functions.scalar import ratio, sentinel_to_null
    return {
        "NAME_CONTRACT_STATUS": F.col("CREDIT_ACTIVE"),
        "NAME_PRIORITY": F.col("CREDIT_TYPE"),
        "AMT_APPLICATION": F.col("AMT_CREDIT_SUM"),
        "CNT_PAYMENT": F.col("MONTHS_BALANCE_SIZE"),
        "DAYS_DECISION": sentinel_to_null(F.col("DAYS_CREDIT"), sentinel),
        "DAYS_FIRST_DUE": sentinel_to_null(_days("first_ship"), sentinel),
        "APP_CREDIT_PERC": ratio(F.col("AMT_CREDIT_SUM"), F.col("AMT_CREDIT"), ieee),
    }


def pos_cash(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("SK_ID_CURR"),
        _days("ts", EVENT_REF_DATE).alias("MONTHS_BALANCE"),
        F.col("value").alias("SK_DPD"),
        F.get_json_object("props", "$.k").cast("double").alias("SK_DPD_DEF"),
        F.col("event_type").alias("NAME_CONTRACT_STATUS"),
    )


def credit_card(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("SK_ID_PREV"),
        F.col("user_id").alias("SK_ID_CURR"),
        _days("ts", EVENT_REF_DATE).alias("MONTHS_BALANCE"),
        F.col("value").alias("AMT_BALANCE"),
        F.get_json_object("props", "$.k").cast("double").alias("CNT_DRAWINGS"),
        F.col("event_type").alias("NAME_CONTRACT_STATUS"),
    )


def installments(spark: SparkSession, d: str) -> DataFrame:
    """lineitem JOIN orders on the order key (fact-fact join; AQE splits a skewed
    order key on the lineitem side)."""
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    return j.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("l_linenumber").alias("NUM_INSTALMENT_VERSION"),
        (F.col("l_extendedprice") / 1000).alias("AMT_INSTALMENT"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("AMT_PAYMENT"),
        _days("o_orderdate").alias("DAYS_INSTALMENT"),
        _days("l_shipdate").alias("DAYS_ENTRY_PAYMENT"),
        F.col("l_returnflag").alias("PAYMENT_FLAG"),
    )


def _count(t, chars: str):
    """How many of the given characters the whole text holds: what ``translate``
    takes out of it (no array of matches, no regular expression)."""
    return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")


# The character classes counted.
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTED = "[^ \n0-9A-Z@!?]+"  # all others


_ENTITY_TABLES: dict[tuple, str] = {}


def documents_entity(spark: SparkSession, d: str, materialize: bool = True) -> DataFrame:
    """Labelled + unlabelled entity: one row per document, TARGET = toxic (NULL when
    the document has no label). Features are character-class counts over the whole
    text; token and line counts are separator counts + 1 (the piece count of a
    split on that separator).

    The text scan is the expensive part and many plans read this table, so it is
    written once per application into the shared checkpoint folder and read back."""
    key = (spark.sparkContext.applicationId, d)
    if materialize and key in _ENTITY_TABLES:
        return spark.read.parquet(_ENTITY_TABLES[key])
    docs = read_table(spark, d, "documents")
    labels = read_table(spark, d, "labels").select("doc_id", "toxic")
    t = F.regexp_replace("text", COUNTED, "")  # one pass over the whole text; the counts read the short rest
    spaces = _count(t, " ")
    # measured before the join, so that no text is shuffled to attach a label
    measures = docs.select(
        "doc_id",
        F.col("lang").alias("LANG"),
        F.col("source").alias("SOURCE"),
        F.col("n_chars").cast("double").alias("N_CHARS"),
        (spaces + 1).alias("N_SPACE_TOKENS"),
        (_count(t, "\n") + 1).alias("N_LINES"),
        _count(t, DIGITS).alias("N_DIGITS"),
        _count(t, UPPER).alias("N_UPPER"),
        _count(t, "@").alias("N_AT"),
        _count(t, "!?").alias("N_EXCLAIM"),
        spaces.alias("N_SPACES"),
    )
    ent = measures.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("SK_ID_CURR"), F.col("toxic").alias("TARGET"), *measures.columns[1:])
    if not materialize:
        return ent
    from riskweave.session import scratch_path
    path = scratch_path(spark, "documents-entity")
    ent.write.mode("overwrite").parquet(path)
    _ENTITY_TABLES[key] = path
    return spark.read.parquet(path)
