"""Hand-made fixtures for the NULL / zero / one-row cases (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions.scalar import null_safe_ne, positive_part, ratio, sanitize_columns, find_bad_names
from riskweave.operators.aggregate import Subset, category_share_exprs, grouped
from riskweave.operators.clean import narrow_types, with_position
from riskweave.operators.encode import FactorizeSpec, OneHotSpec


def rows(df, *cols):
    data = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in data), key=lambda t: tuple((v is None, repr(v)) for v in t))


def test_null_safe_exclusion_keeps_null(spark):
    df = spark.createDataFrame([(1, "F"), (2, "M"), (3, "XNA"), (4, None)], "k int, g string")
    kept = [r.k for r in df.where(null_safe_ne("g", "XNA")).orderBy("k").collect()]
    assert kept == [1, 2, 4]
    # the plain comparison would drop the NULL row
    assert df.where(F.col("g") != "XNA").count() == 2


def test_onehot_nan_column_present_and_null_row(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "k int, s string")
    spec = OneHotSpec.fit(a, ["s"], nan_column=True)
    assert spec.new_columns == ["s_A", "s_B", "s_nan"]
    out = {r.k: (r.s_A, r.s_B, r.s_nan) for r in spec.transform(a).collect()}
    assert out == {1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 1.0)}
    b = spark.createDataFrame([(1, "A"), (2, "B")], "k int, s string")
    outb = OneHotSpec.fit(b, ["s"]).transform(b)
    assert "s_nan" in outb.columns and outb.agg(F.sum("s_nan")).first()[0] == 0.0
    no_nan = OneHotSpec.fit(a, ["s"], nan_column=False).transform(a)
    assert [r.s_A + r.s_B for r in no_nan.where("k = 3").collect()] == [0.0]


def test_factorize_first_appearance_and_null(spark):
    df = spark.createDataFrame([(5, "x"), (1, "y"), (3, None), (2, "x")], "k int, c string")
    fac = FactorizeSpec.fit(df, ["c"], order_col="k")
    got = {r.k: r.c for r in fac.transform(df).collect()}
    assert got == {1: 0, 2: 1, 5: 1, 3: -1}  # y first seen at k=1, x at k=2


def test_category_share_counts_null_in_denominator(spark):
    df = spark.createDataFrame([(1, "A"), (1, None)], "k int, s string")
    r = df.groupBy("k").agg(*category_share_exprs("s", ["A"])).first()
    assert r.s_A_MEAN == 0.5 and r.s_nan_MEAN == 0.5


def test_sum_of_all_null_group_is_zero_mean_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "k int, x double")
    out = {r.k: (r.x_SUM, r.x_MEAN) for r in grouped(df, "k", {"x": ["sum", "mean"]}).collect()}
    assert out[1] == (0.0, None) and out[2] == (3.0, 3.0)


def test_var_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0)], "k int, x double")
    out = {r.k: r.x_VAR for r in grouped(df, "k", {"x": ["var"]}).collect()}
    assert out[1] is None and out[2] == 2.0


def test_size_counts_null_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "k int, x double")
    r = grouped(df, "k", {"x": ["size"]}, extra=[F.count("x").alias("n")]).first()
    assert r.x_SIZE == 2 and r.n == 1


SUB_SPEC = {"amt": ["sum", "mean", "max"]}


def _subset_fixture(spark):
    # client 1: rows but none active; client 2: active rows, amounts all NULL; client 3: normal
    return spark.createDataFrame(
        [(1, "Closed", 5.0), (1, "Closed", 7.0), (2, "Active", None), (2, "Active", None),
         (3, "Active", 1.0), (3, "Closed", 2.0), (3, None, 4.0)], "k int, status string, amt double")


def test_subset_aggregates_null_vs_zero(spark):
    df = _subset_fixture(spark)
    out = grouped(df, "k", SUB_SPEC, "T_", subsets=[Subset("ACTIVE_", F.col("status").eqNullSafe("Active"))])
    got = {r.k: r for r in out.collect()}
    assert got[1].ACTIVE_amt_SUM is None and got[1].ACTIVE_amt_MEAN is None  # no subset row: NULL everywhere
    assert got[2].ACTIVE_amt_SUM == 0.0 and got[2].ACTIVE_amt_MEAN is None  # rows, all amounts NULL
    assert got[3].ACTIVE_amt_SUM == 1.0 and got[3].T_amt_SUM == 7.0


def test_fused_subset_equals_filter_group_join(spark):
    df = _subset_fixture(spark)
    fused = grouped(df, "k", SUB_SPEC, "T_", subsets=[Subset("ACTIVE_", F.col("status").eqNullSafe("Active"))])
    total = grouped(df, "k", SUB_SPEC, "T_")
    active = grouped(df.where(F.col("status") == "Active"), "k", SUB_SPEC, "ACTIVE_")
    joined = total.join(active, "k", "left")
    cols = sorted(fused.columns)
    assert rows(fused, *cols) == rows(joined, *cols)


def test_two_level_bureau_without_balance_rows(spark):
    bb = spark.createDataFrame([(10, 1), (10, 2)], "b int, m int")
    bur = spark.createDataFrame([(1, 10), (1, 11)], "k int, b int")
    bb_agg = grouped(bb, "b", {"m": ["min", "max", "size"]})
    j = bur.join(bb_agg, "b", "left")
    r = grouped(j, "k", {"m_SIZE": ["mean", "sum"], "m_MIN": ["min"]}).first()
    assert r.m_SIZE_MEAN == 2.0 and r.m_SIZE_SUM == 2 and r.m_MIN_MIN == 1


def test_positive_part_and_ratio_policies(spark):
    df = spark.createDataFrame([(None, 5, 10.0, 0.0), (3, 5, 10.0, 5.0), (9, 5, 0.0, 5.0)],
                               "entry int, inst int, amt double, pay double")
    out = df.select(positive_part(F.col("entry") - F.col("inst")).alias("dpd"),
                    positive_part(F.col("inst") - F.col("entry")).alias("dbd"),
                    ratio("pay", "amt").alias("perc"), ratio("pay", "amt", ieee=True).alias("perc_ieee")).collect()
    assert [(r.dpd, r.dbd) for r in out] == [(0, 0), (0, 2), (4, 0)]
    assert out[0].perc == 0.0 and out[2].perc is None and math.isinf(out[2].perc_ieee)


def test_sanitize_and_narrow(spark):
    df = spark.createDataFrame([(None, 1.5, 1, 7, "a"), (2, 2.5, 0, 8, "b")],
                               "SK_ID_CURR long, x double, flag int, n long, s string").toDF(
        "SK_ID_CURR", "x y", "flag", "n:1", "s")
    clean = sanitize_columns(df)
    assert clean.columns == ["SK_ID_CURR", "x_y", "flag", "n_1", "s"] and not find_bad_names(clean.columns)
    n = narrow_types(clean)
    types = dict(n.dtypes)
    assert types == {"SK_ID_CURR": "int", "x_y": "float", "flag": "boolean", "n_1": "int", "s": "string"}
    assert sorted(r.SK_ID_CURR for r in n.collect()) == [0, 2]
    with pytest.raises(ValueError):
        sanitize_columns(df.toDF("a b", "a_b", "c", "d", "e"))


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k").repartition(5)
    pos = with_position(df, "k", num_partitions=4).orderBy("k").collect()
    assert [r.POSITION for r in pos] == list(range(1, len(pos) + 1))
