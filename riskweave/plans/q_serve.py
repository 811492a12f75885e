"""Registered queries: linear explanations, waterfall, importance, local rows,
batch scoring, request validation, response records, display table and the
streaming scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.scalar import round_doubles, round_fixed
from riskweave.operators.clean import with_position
from riskweave.operators.explain import global_importance, linear_contributions, linear_phi, waterfall
from riskweave.operators.score import (
    client_table, client_view, decide, lookup, rejects, response_records, validate_requests,
)
from riskweave.plans import entities as E
from riskweave.plans import scoring as SC
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register
from riskweave.session import scratch_path
from riskweave.streaming.score_stream import reject_stream, run_available_now, scoring_stream
from riskweave.streaming.serve import REJECTS, RESPONSES, publish_clients, serve_available, served

KEY = E.KEY
F8 = SC.LIN_FEATURES


def _w(k):
    return f"CAST('{SC.LIN_WEIGHTS[k]!r}' AS DOUBLE)"


_STATS = ("stats AS (SELECT " + ", ".join(f"avg({c}) AS m{k}, stddev_samp({c}) AS s{k}" for k, c in enumerate(F8))
          + " FROM documents_entity)")
_LC = ("lc AS (" + "\n  UNION ALL ".join(
    f"SELECT SK_ID_CURR, '{c}' AS feature, {_w(k)} * ({c} - m{k}) / s{k} AS phi FROM documents_entity, stats"
    for k, c in enumerate(F8)) + ")")


def _lin_sql(*extra):
    return S.with_roles("documents_entity", extra=[_STATS, _LC, *extra])


@register("q_linear_contrib", _lin_sql() + f"SELECT SK_ID_CURR, feature, {S.r6('phi')} AS phi FROM lc")
def q_linear_contrib(spark, d):
    """XP7: standardised linear contributions phi = w (x - mean) / sd, long form."""
    long, _ = SC.linear_long(spark, d)
    return round_doubles(long)


@register("q_global_importance", _lin_sql()
          + f"SELECT feature, {S.r6('avg(abs(phi))')} AS mean_abs_phi FROM lc GROUP BY feature")
def q_global_importance(spark, d):
    """XP3: mean |phi| per feature."""
    long, _ = SC.linear_long(spark, d)
    return round_doubles(global_importance(long))


_WF = f"""lr AS (SELECT SK_ID_CURR, feature, {S.r6('phi')} AS phi FROM lc),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(phi) DESC, feature DESC) AS rk
  FROM lr) t WHERE rk <= {SC.WATERFALL_TOP}),
wf AS (SELECT SK_ID_CURR, feature, phi,
  CAST(row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(phi), feature) AS INTEGER) AS step,
  0.0 + sum(phi) OVER (PARTITION BY SK_ID_CURR ORDER BY abs(phi), feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "end"
  FROM kept)"""


@register("q_waterfall", _lin_sql(_WF) + f"""SELECT SK_ID_CURR, feature, phi, step, {S.r6('"end" - phi')} AS start,
  {S.r6('"end"')} AS "end", CASE WHEN phi > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM wf""")
def q_waterfall(spark, d):
    """XP5: per client the 15 largest |phi|, cumulated from the base in ascending
    |phi| order (ties by feature name)."""
    docs = SC.roles.documents_entity(spark, d)
    phi = {f: round_fixed(c) for f, c in linear_phi(docs, F8, SC.LIN_WEIGHTS).items()}
    return round_doubles(waterfall(docs, KEY, phi, 0.0, SC.WATERFALL_TOP))


@register("q_local_row", _lin_sql(
    "pos AS (SELECT SK_ID_CURR, row_number() OVER (ORDER BY SK_ID_CURR) AS POSITION FROM documents_entity)")
    + f"SELECT POSITION, SK_ID_CURR, feature, {S.r6('phi')} AS phi FROM lc JOIN pos USING (SK_ID_CURR) "
      f"WHERE POSITION IN {SC.LOCAL_POSITIONS}")
def q_local_row(spark, d):
    """XP4: the explanation rows of the clients at positions 1 and 24."""
    docs = SC.roles.documents_entity(spark, d)
    pos = with_position(docs.select(KEY), KEY)
    sel = pos.where(F.col("POSITION").isin(*SC.LOCAL_POSITIONS))  # before contributions are made
    long, _ = linear_contributions(docs.join(sel.select(KEY), KEY, "left_semi"), KEY, F8, SC.LIN_WEIGHTS, fit_on=docs)
    return round_doubles(long.join(sel, KEY).select("POSITION", KEY, "feature", "phi"))


# ---------------------------------------------------------------- scoring
_PHI_SQL = ", ".join(f"{_w(k)} * ({c} - m{k}) / s{k} AS phi_{c}" for k, c in enumerate(F8))
_PROD = ("prod AS (SELECT SK_ID_CURR, " + ", ".join(F8)
         + ", row_number() OVER (ORDER BY SK_ID_CURR) AS POSITION FROM documents_entity WHERE TARGET IS NULL)")
_SCORED = (f"sp AS (SELECT prod.*, {_PHI_SQL} FROM prod, stats),\n"
           "spm AS (SELECT *, " + " + ".join(f"phi_{c}" for c in F8) + " AS margin FROM sp),\n"
           "scored AS (SELECT *, CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-margin)) AS proba FROM spm)")
_CLASS = (f"CASE WHEN proba > {SC.DECISION_THRESHOLD} THEN 'default' ELSE 'no default' END AS Class, "
          f"CASE WHEN proba > {SC.DECISION_THRESHOLD} THEN 'Reject loan application' "
          "ELSE 'Accept loan application' END AS Decision")


def _score_sql(*extra):
    return S.with_roles("documents_entity", extra=[_STATS, _PROD, _SCORED, *extra])


def _scored_prod(spark, d):
    return SC.with_linear_score(SC.prod_clients(spark, d), SC.linear_stats(spark, d))


@register("q_score_decisions", _score_sql()
          + f"SELECT POSITION AS Client_id, SK_ID_CURR, {S.r6('proba')} AS proba, {_CLASS} FROM scored")
def q_score_decisions(spark, d):
    """SC1/SC2: every client scored; strict > threshold decides (0.3)."""
    sc = _scored_prod(spark, d)
    cls, dec = decide(F.col("proba"), SC.DECISION_THRESHOLD)
    return round_doubles(sc.select(F.col("POSITION").alias("Client_id"), KEY, "proba",
                                   cls.alias("Class"), dec.alias("Decision")))


_REQ = ("req AS (SELECT event_id AS request_no, CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR)"
        " WHEN 'view' THEN CAST(-user_id AS VARCHAR) WHEN 'error' THEN CAST(user_id AS VARCHAR) ||"
        " CASE WHEN event_id % 2 = 0 THEN '00000000000000000000' ELSE '.5' END"
        " WHEN 'purchase' THEN CAST(user_id + 1000000 AS VARCHAR) ELSE event_type END AS raw FROM events)")
_N = "(SELECT count(*) FROM prod)"
_VALID = (f"val AS (SELECT request_no, raw, CASE WHEN regexp_full_match(raw, '^-?[0-9]+$') THEN TRY_CAST(raw AS BIGINT) END AS client_id,\n"
          f"  CASE WHEN NOT regexp_full_match(raw, '^-?[0-9]+$') THEN 'not_integer'\n"
          f"       WHEN TRY_CAST(raw AS BIGINT) BETWEEN 1 AND {_N} THEN 'ok' ELSE 'not_found' END AS status FROM req),\n"
          f"valm AS (SELECT *, CASE status WHEN 'not_integer' THEN 'Client id must be a whole number.'\n"
          f"  WHEN 'not_found' THEN 'Client id not in application database. Enter a whole number between 1 and '"
          f" || CAST({_N} AS VARCHAR) || '.' END AS message FROM val)")


@register("q_request_validation", _score_sql(_REQ, _VALID) + """
SELECT request_no, raw, client_id, status, message, p.SK_ID_CURR
FROM valm LEFT JOIN prod p ON valm.status = 'ok' AND valm.client_id = p.POSITION""")
def q_request_validation(spark, d):
    """SC3/JN5/JN6: request ids checked (integer? in 1..n?) and looked up by
    position; rejected requests keep their reason."""
    prod = SC.prod_clients(spark, d)
    n = prod.count()
    v = validate_requests(SC.requests(spark, d), "raw", n)
    ids = prod.select(F.col("POSITION").alias("_pos"), KEY)
    # only found requests are joined; rejects (no key to join on) are added as they are
    found = v.where(F.col("status") == "ok").join(ids, F.col("client_id") == F.col("_pos")).drop("_pos")
    cols = ["request_no", "raw", "client_id", "status", "message", KEY]
    return found.select(*cols).unionByName(
        rejects(v).withColumn(KEY, F.lit(None).cast(prod.schema[KEY].dataType)).select(*cols))


def _json_sql(cols, names):
    parts = [f"'{'{' if i == 0 else ','}\"{n}\":' || coalesce(CAST(CAST({c} AS DECIMAL(20,6)) AS VARCHAR), 'null')"
             for i, (c, n) in enumerate(zip(cols, names))]
    return "'[' || " + " || ".join(parts) + " || '}]'"


@register("q_response_record", _score_sql(_REQ, _VALID) + f"""
SELECT request_no, client_id AS Client_id, {S.r6('proba')} AS "Client default probability", {_CLASS},
  {_json_sql(F8, F8)} AS Client_info, CAST(0.0 AS DOUBLE) AS Expected_Shap_Value,
  {_json_sql([S.r6('phi_' + c) for c in F8], F8)} AS Shap_values_client
FROM valm JOIN scored s ON valm.status = 'ok' AND valm.client_id = s.POSITION""")
def q_response_record(spark, d):
    """SC4: one response row per found request (request_id omitted here; the
    operator adds a uuid when asked)."""
    prod = SC.prod_clients(spark, d)
    n = prod.count()
    sc = SC.with_linear_score(prod, SC.linear_stats(spark, d))
    sc = sc.withColumns({f"phi_{c}": round_fixed(f"phi_{c}") for c in F8})
    found = lookup(validate_requests(SC.requests(spark, d), "raw", n), sc)
    rr = response_records(found, F8, [f"phi_{c}" for c in F8], 0.0, SC.DECISION_THRESHOLD,
                          with_request_id=False, keep=["request_no"])
    # decide on the exact probability, present it rounded
    return rr.withColumn("Client default probability", round_fixed("`Client default probability`"))


_VIEW = ("vw AS (SELECT request_no, client_id, round((" + S.r6("proba") + ") * 100, 1) AS pct, " + _CLASS + ", "
         + ", ".join(f"CAST(CAST({c} AS DECIMAL(20,6)) AS DOUBLE) AS {c}" for c in F8)
         + " FROM valm JOIN scored s ON valm.status = 'ok' AND valm.client_id = s.POSITION)")


@register("q_client_view", _score_sql(_REQ, _VALID, _VIEW) + f"""
SELECT client_id AS Client_id, upper(Decision) AS decision_text, CAST(pct AS VARCHAR) || ' %' AS probability_text,
  {', '.join(F8)} FROM vw""")
def q_client_view(spark, d):
    """SC5: responses decoded from their JSON records, with percentage and capitals as shown to a user."""
    return client_view(q_response_record(spark, d), F8)


@register("q_client_table", _score_sql() + """
SELECT Client_id, field, value FROM (
""" + "\n  UNION ALL ".join(f"SELECT POSITION AS Client_id, '{c}' AS field, round({c}, 4) AS value FROM scored"
                          for c in F8) + """
  UNION ALL SELECT POSITION, 'default_probability_pct', round(proba * 100, 1) FROM scored) t""")
def q_client_table(spark, d):
    """SC5: display table per client (features rounded to 4, probability in %)."""
    sc = _scored_prod(spark, d).withColumnRenamed("POSITION", "Client_id")
    return client_table(sc, "Client_id", F8, "proba")


@register("q_stream_score", _score_sql(_REQ, _VALID) + f"""
SELECT request_no, client_id AS Client_id, s.SK_ID_CURR, {S.r6('proba')} AS proba, {_CLASS}
FROM valm JOIN scored s ON valm.status = 'ok' AND valm.client_id = s.POSITION""")
def q_stream_score(spark, d):
    """SC6: requests arrive as files; a Structured Streaming query validates them,
    joins the static client table and appends scored rows to a parquet sink with a
    checkpoint (trigger availableNow); the sink is read back."""
    # the static side is a written table (positions fixed once, plain scan in the stream)
    prod_dir = scratch_path(spark, "clients")
    SC.prod_clients(spark, d).write.mode("overwrite").parquet(prod_dir)
    prod = spark.read.parquet(prod_dir)
    n = prod.count()
    stats = SC.linear_stats(spark, d)
    req_dir = scratch_path(spark, "requests")
    SC.requests(spark, d).write.mode("overwrite").parquet(req_dir)
    stream = scoring_stream(spark, req_dir, SC.REQUEST_SCHEMA, "raw", prod, n,
                            lambda df: SC.with_linear_score(df, stats), SC.DECISION_THRESHOLD)
    out = stream.select("request_no", F.col("client_id").alias("Client_id"), KEY,
                        round_fixed("proba").alias("proba"), "Class", "Decision")
    sink, ckpt = scratch_path(spark, "scored"), scratch_path(spark, "stream-ckpt")
    run_available_now(out, sink, ckpt)
    return spark.read.parquet(sink)


@register("q_stream_rejects", _score_sql(_REQ, _VALID)
          + "SELECT request_no, raw, client_id, status, message FROM valm WHERE status <> 'ok'")
def q_stream_rejects(spark, d):
    """SC6/JN6: the stream's side output: rejected requests with the reason, in a sink of their own."""
    n = SC.prod_clients(spark, d).count()
    req_dir = scratch_path(spark, "requests")
    SC.requests(spark, d).write.parquet(req_dir)
    out = reject_stream(spark, req_dir, SC.REQUEST_SCHEMA, "raw", n)
    sink = scratch_path(spark, "rejects")
    run_available_now(out, sink, scratch_path(spark, "stream-ckpt"))
    return spark.read.parquet(sink)


@register("q_stream_serve", _score_sql(_REQ, _VALID) + f"""
SELECT request_no, client_id AS Client_id, status, message, s.SK_ID_CURR, {S.r6('proba')} AS proba, {_CLASS}
FROM valm JOIN scored s ON valm.status = 'ok' AND valm.client_id = s.POSITION
UNION ALL SELECT request_no, client_id, status, message, NULL, NULL, NULL, NULL FROM valm WHERE status <> 'ok'""")
def q_stream_serve(spark, d):
    """SC6: one read of the request stream into two sinks, responses and rejects, by batch; clients from the
    versioned registry. Both sinks are read back."""
    root, req_dir = scratch_path(spark, "clients"), scratch_path(spark, "requests")
    publish_clients(spark, root, SC.prod_clients(spark, d))
    SC.requests(spark, d).write.parquet(req_dir)
    stats, out = SC.linear_stats(spark, d), scratch_path(spark, "served")
    serve_available(spark, req_dir, SC.REQUEST_SCHEMA, "raw", root, lambda df: SC.with_linear_score(df, stats), SC.DECISION_THRESHOLD,
                    out, scratch_path(spark, "stream-ckpt"), keep=["request_no", "client_id", "status", "message", KEY, "proba"])
    cols = ["request_no", F.col("client_id").alias("Client_id"), "status", "message"]
    answers = served(spark, out, RESPONSES).select(*cols, KEY, round_fixed("proba").alias("proba"), "Class", "Decision")
    return answers.unionByName(served(spark, out, REJECTS).select(*cols), allowMissingColumns=True)
