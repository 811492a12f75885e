"""Physical-plan checks: pushdown and pruning reach the scan, the flagship stays on
the JVM, aggregates run before the client-level joins."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    p = _plan(E.queries()["q_scan_project"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    schema = p[p.index("ReadSchema: struct<") + len("ReadSchema: struct<"):].split(">")[0]
    fields = [f.split(":")[0] for f in schema.split(",")]
    assert fields == ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]


def test_flagship_has_no_python(spark):
    p = _plan(E.entry(spark))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_wide_aggregates_before_joins(spark):
    from riskweave.plans import features as fx
    p = fx.wide_features(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # five sources in three client-level aggregates + per-order + category-free app side
    assert p.count("Aggregate [SK_ID_CURR") == 3
