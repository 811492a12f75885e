"""NaN is missing from the first read on; remembered tables can be dropped."""

import os
import tempfile

from riskweave.operators.clean import narrow_types
from riskweave.operators.correlate import collinear_cut
from riskweave.operators.encode import FactorizeSpec
from riskweave.operators.profile import missing_report
from riskweave.plans import catalog
from riskweave.sources.tables import read_table


def test_nan_becomes_null_and_a_rewritten_folder_is_seen(spark):
    d = tempfile.mkdtemp(prefix="rw-ingest-")
    path = os.path.join(d, "customer.parquet")
    schema = "c_custkey long, c_acctbal double"
    spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None)], schema).write.parquet(path)
    df = read_table(spark, d, "customer")
    assert {r.feature: r.n_missing for r in missing_report(df).collect()} == {"c_custkey": 0, "c_acctbal": 2}
    assert df.selectExpr("avg(c_acctbal) a", "max(c_acctbal) m").first() == (2.0, 2.0)
    spark.createDataFrame([(9, 1.0)], schema).write.mode("overwrite").parquet(path)
    catalog.forget()
    assert [r.c_custkey for r in read_table(spark, d, "customer").collect()] == [9]


def test_narrowing_never_loses_values(spark):
    rows = [(3_000_000_000, 1, 1e300, 5, 0), (None, 2, 1.5, 1 << 40, 1)]
    out = narrow_types(spark.createDataFrame(rows, "SK_ID_A long, SK_ID_B long, big double, wide long, flag int"))
    assert dict(out.dtypes) == {"SK_ID_A": "bigint", "SK_ID_B": "int", "big": "double", "wide": "bigint", "flag": "boolean"}
    assert sorted(map(tuple, out.collect())) == [(0, 2, 1.5, 1 << 40, True), (3_000_000_000, 1, 1e300, 5, False)]


def test_a_protected_column_still_removes_others(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, (i * 7919) % 13 * 1.0) for i in range(30)], "p double, q double, z double")
    assert collinear_cut(df, protect=["p"])[1] == ["q"]
    assert collinear_cut(df, protect=["q"])[1] == []


def test_wide_columns_are_factorized_by_a_join(spark):
    df = spark.range(60).selectExpr("id k", "cast(59 - id as string) a", "case when id % 7 > 0 then cast(id % 7 as string) end b")
    few = FactorizeSpec.fit(df, ["a", "b"], "k")
    many = FactorizeSpec.fit(df, ["a", "b"], "k", max_levels=5)
    assert set(many.tables) == {"a", "b"} and not many.codes
    key = lambda spec: sorted(map(tuple, spec.transform(df).collect()))
    assert key(few) == key(many) and key(many)[0] == (0, 0, -1)
