"""Registered queries against their DuckDB oracles (a fast subset at sf0.01; the
full set runs with ``python tools/oracle_check.py``), the driver entry point, and
streaming == batch."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskweave.sources.tables import TABLES

SF = "/root/testdata/sf0.01"
FAST = ["q_bureau_two_level", "q_subset_aggs", "q_positive_part", "q_auc", "q_threshold_sweep",
        "q_corr_pairs", "q_request_validation", "q_row_position", "q_onehot_nan", "q_factorize"]


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return "NULL" if v is None else repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable_and_oracles_are_subset():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 70 and set(o) <= set(q)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, srows) == _canon(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "SK_ID_CURR"


def test_served_model_in_the_stream_equals_batch(spark):
    s = E.queries()["q_stream_response"](spark, SF)
    b = E.queries()["q_response_gbt"](spark, SF)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect())) and s.count() > 0


def test_stream_equals_batch(spark):
    s = E.queries()["q_stream_score"](spark, SF)
    b = E.queries()["q_score_decisions"](spark, SF)
    v = E.queries()["q_request_validation"](spark, SF).where("status = 'ok'").select(
        "request_no", F.col("client_id").alias("cid"))
    batch = v.join(b, v["cid"] == b["Client_id"]).select("request_no", "Client_id", "SK_ID_CURR", "proba",
                                                          "Class", "Decision")
    cols = ["request_no", "Client_id", "SK_ID_CURR", "proba", "Class", "Decision"]
    assert sorted(tuple(r) for r in s.select(*cols).collect()) == sorted(tuple(r) for r in batch.collect())


def test_gbt_response_contributions_add_up_to_probability(spark):
    import json
    rows = E.queries()["q_response_gbt"](spark, SF).limit(50).collect()
    assert rows
    for r in rows:
        shap = json.loads(r["Shap_values_client"])[0]
        info = json.loads(r["Client_info"])[0]
        assert set(shap) == set(info) and "N_CHARS" in info
        margin = r["Expected_Shap_Value"] + sum(float(v) for v in shap.values())
        p = r["Client default probability"]
        assert abs(margin - 0.5 * math.log(p / (1 - p))) < 1e-4 * len(shap)
