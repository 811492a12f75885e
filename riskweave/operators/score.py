"""Scoring (SC1-SC5, JN5-JN6): batch scoring, decision rule, request validation
against the client table, response records and the display table.

Requests and clients are joined on the client's 1-based position (assigned once
by ``with_position``); Spark picks broadcast or sort-merge from the sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels and messages of the decision service.
CLASS_DEFAULT, CLASS_OK = "default", "no default"
DECISION_REJECT, DECISION_ACCEPT = "Reject loan application", "Accept loan application"
MSG_NOT_FOUND = "Client id not in application database. Enter a whole number between 1 and {n}."
MSG_NOT_INTEGER = "Client id must be a whole number."
INTEGER_PATTERN = r"^-?[0-9]+$"


def decide(proba: Column, threshold: float) -> tuple[Column, Column]:
    """SC2: strict ``>``: a probability equal to the threshold is accepted."""
    bad = proba > F.lit(float(threshold))
    return (F.when(bad, F.lit(CLASS_DEFAULT)).otherwise(F.lit(CLASS_OK)),
            F.when(bad, F.lit(DECISION_REJECT)).otherwise(F.lit(DECISION_ACCEPT)))


def validate_requests(requests: DataFrame, raw: str, n_clients: int) -> DataFrame:
    """SC3: ``status`` ok / not_found (404) / not_integer (422), ``client_id`` the
    parsed id for integer input, and a message."""
    is_int = F.col(raw).rlike(INTEGER_PATTERN)
    cid = F.when(is_int, F.col(raw).try_cast("bigint"))
    in_range = (cid >= 1) & (cid <= n_clients)
    # an integer too large for bigint is an id that does not exist
    status = (F.when(~F.coalesce(is_int, F.lit(False)), F.lit("not_integer"))
              .when(in_range, F.lit("ok")).otherwise(F.lit("not_found")))
    msg = (F.when(status == "not_integer", F.lit(MSG_NOT_INTEGER))
           .when(status == "not_found", F.lit(MSG_NOT_FOUND.format(n=n_clients))))
    return requests.withColumns({"client_id": cid, "status": status, "message": msg})


def lookup(valid: DataFrame, clients: DataFrame, position: str = "POSITION") -> DataFrame:
    """JN5: requests JOIN client table on position (only status ok rows)."""
    ok = valid.where(F.col("status") == "ok")
    return ok.join(clients, ok["client_id"] == clients[position], "inner").drop(position)


def rejects(valid: DataFrame) -> DataFrame:
    """JN6: the rejected side output."""
    return valid.where(F.col("status") != "ok")


def json_record(cols: list[str]) -> Column:
    """One-record JSON list; numbers as fixed 6-decimal values, NULL kept. Numbers that are not finite, which
    JSON lacks, or of 1e32 and more are NULL."""
    return _json_numbers([(c, c) for c in cols])


def _json_numbers(cols: list[tuple[str, str]]) -> Column:
    """The JSON list of one record with the numbers of (column, name in the record)."""
    return F.to_json(F.array(F.struct(*[F.col(f"`{c}`").try_cast("decimal(38,6)").alias(name) for c, name in cols])),
                     {"ignoreNullFields": "false"})


def response_records(scored: DataFrame, feature_cols: list[str], phi_cols: list[str], expected: float,
                     threshold: float, with_request_id: bool = True, keep: list[str] | None = None,
                     shap_names: list[str] | None = None) -> DataFrame:
    """SC4: the response row. ``scored`` has client_id, proba, the features and
    their contributions ``phi_cols`` (named ``shap_names`` in the JSON, default the
    feature names)."""
    shap_names = feature_cols if shap_names is None else shap_names
    if len(shap_names) != len(phi_cols):
        raise ValueError("one name per contribution column is needed")
    cls, dec = decide(F.col("proba"), threshold)
    phi_struct = _json_numbers(list(zip(phi_cols, shap_names)))
    cols = [F.col("client_id").alias("Client_id"), F.col("proba").alias("Client default probability"),
            cls.alias("Class"), dec.alias("Decision"), json_record(feature_cols).alias("Client_info"),
            F.lit(float(expected)).alias("Expected_Shap_Value"), phi_struct.alias("Shap_values_client")]
    if with_request_id:
        cols.insert(0, F.expr("uuid()").alias("request_id"))
    return scored.select(*(keep or []), *cols)


def client_view(responses: DataFrame, feature_cols: list[str]) -> DataFrame:
    """A served response as it is shown: the decision in capitals, the probability as a
    percentage text, and the client's features decoded from the JSON record."""
    record = F.from_json("Client_info", "array<struct<" + ",".join(f"`{c}`:double" for c in feature_cols) + ">>")[0]
    p = F.col("Client default probability")
    return responses.select("Client_id", F.upper("Decision").alias("decision_text"),
                            F.concat(F.round(p * 100, 1).cast("string"), F.lit(" %")).alias("probability_text"),
                            *[record[c].alias(c) for c in feature_cols])


def client_table(clients: DataFrame, id_col: str, feature_cols: list[str], proba: str | None = None) -> DataFrame:
    """SC5: long display table (client, field, value): values rounded to 4
    decimals, probability as a percentage with one decimal."""
    items = [F.struct(F.lit(c).alias("field"), F.round(F.col(f"`{c}`").cast("double"), 4).alias("value"))
             for c in feature_cols]
    if proba:
        items.append(F.struct(F.lit("default_probability_pct").alias("field"),
                              F.round(F.col(proba) * 100, 1).alias("value")))
    return clients.select(id_col, F.explode(F.array(*items)).alias("t")).select(id_col, "t.field", "t.value")
