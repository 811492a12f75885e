"""The reference's prediction-service tests re-stated on DataFrames: 10 clients x 5
features, threshold 0.3, expected value 0.12, mocked probabilities."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators.clean import with_position
from riskweave.operators.score import (
    CLASS_DEFAULT, CLASS_OK, DECISION_ACCEPT, DECISION_REJECT, client_table, decide, lookup,
    response_records, validate_requests,
)

N_CLIENTS, FEATURES, THRESHOLD, EXPECTED = 10, ["feat_1", "feat_2", "feat_3", "feat_4", "feat_5"], 0.3, 0.12
REQUIRED = {"request_id", "Client_id", "Client default probability", "Class", "Decision", "Client_info",
            "Expected_Shap_Value", "Shap_values_client"}


@pytest.fixture(scope="module")
def clients(spark):
    np.random.seed(42)
    data = pd.DataFrame(np.random.rand(N_CLIENTS, 5), columns=FEATURES)
    np.random.seed(0)
    shap = pd.DataFrame(np.random.rand(N_CLIENTS, 5), columns=[f"phi_{f}" for f in FEATURES])
    pdf = pd.concat([data, shap], axis=1)
    pdf.insert(0, "row", np.arange(N_CLIENTS))
    return with_position(spark.createDataFrame(pdf), "row")


def _respond(spark, clients, raw_ids, proba):
    req = spark.createDataFrame([(i, str(r)) for i, r in enumerate(raw_ids)], "request_no long, raw string")
    v = validate_requests(req, "raw", N_CLIENTS)
    found = lookup(v, clients.withColumn("proba", F.lit(proba)))
    rr = response_records(found, FEATURES, [f"phi_{f}" for f in FEATURES], EXPECTED, THRESHOLD, keep=["request_no"])
    return v, rr


@pytest.mark.parametrize("rid", [1, N_CLIENTS, 3])
def test_found_ids_echoed(spark, clients, rid):
    v, rr = _respond(spark, clients, [rid], 0.3)
    r = rr.first()
    assert r["Client_id"] == rid and REQUIRED.issubset(rr.columns)
    assert 0.0 <= r["Client default probability"] <= 1.0


@pytest.mark.parametrize("rid", [0, -5, N_CLIENTS + 1])
def test_out_of_range_not_found(spark, clients, rid):
    v, rr = _respond(spark, clients, [rid], 0.3)
    r = v.first()
    assert r.status == "not_found" and f"between 1 and {N_CLIENTS}" in r.message and rr.count() == 0


@pytest.mark.parametrize("raw", ["abc", "1.5"])
def test_non_integer_rejected(spark, clients, raw):
    v, _ = _respond(spark, clients, [raw], 0.3)
    assert v.first().status == "not_integer"


@pytest.mark.parametrize("proba,cls,dec", [(0.8, CLASS_DEFAULT, DECISION_REJECT), (0.2, CLASS_OK, DECISION_ACCEPT),
                                           (0.3, CLASS_OK, DECISION_ACCEPT)])
def test_decision_rule_strict(spark, clients, proba, cls, dec):
    _, rr = _respond(spark, clients, [1], proba)
    r = rr.first()
    assert (r["Class"], r["Decision"]) == (cls, dec)


def test_json_fields_are_one_record_with_all_features(spark, clients):
    _, rr = _respond(spark, clients, [1], 0.4)
    r = rr.first()
    info, shap = json.loads(r["Client_info"]), json.loads(r["Shap_values_client"])
    assert isinstance(info, list) and len(info) == 1 and set(info[0]) == set(FEATURES)
    assert isinstance(shap, list) and len(shap) == 1 and set(shap[0]) == set(FEATURES)
    assert r["Expected_Shap_Value"] == EXPECTED
    assert len(r["request_id"]) == 36


def test_sc2_vs_ml13_at_equality(spark):
    df = spark.createDataFrame([(0.3,)], "p double")
    cls, _ = decide(F.col("p"), 0.3)
    r = df.select(cls.alias("c"), (F.col("p") >= 0.3).alias("ge")).first()
    assert r.c == CLASS_OK and r.ge is True


def test_client_table_long(spark, clients):
    t = client_table(clients.withColumn("proba", F.lit(0.12345)), "POSITION", FEATURES, "proba")
    assert t.count() == N_CLIENTS * 6
    assert t.where("field = 'default_probability_pct'").first().value == 12.3


def test_json_record_keeps_large_numbers_and_has_no_odd_ones(spark):
    import json

    from riskweave.operators.score import json_record
    df = spark.createDataFrame([(1.5e20, -2.0000005, float("nan"), 1e40, None, 3)], "a double, b double, c double, d double, e double, `f g` int")
    text = df.select(json_record(df.columns).alias("r")).first().r
    assert '"a":150000000000000000000.000000' in text
    record = json.loads(text)[0]
    assert abs(record["b"] + 2.0000005) <= 1e-6 and record["f g"] == 3
    assert [record[c] for c in "cde"] == [None, None, None]
