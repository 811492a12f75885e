"""Correlation and selection properties: Gram == pandas pairwise corr, the
aggregate path == Gram, collinearity-cut semantics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskweave.operators.correlate import collinear_drop, pairwise_corr, pairwise_corr_agg, top_bottom


def _fixture(spark):
    rng = np.random.default_rng(7)
    n = 60
    a = rng.normal(size=n)
    b = a + 0.3 * rng.normal(size=n)
    c = b + 0.3 * rng.normal(size=n)
    neg = -a + 0.1 * rng.normal(size=n)
    const = np.full(n, 3.0)
    holes = rng.normal(size=n)
    holes[::3] = np.nan
    pdf = pd.DataFrame({"k": np.arange(n), "a": a, "b": b, "c": c, "neg": neg, "const": const, "holes": holes})
    sdf = spark.createDataFrame(pdf).select("k", *[F.nanvl(F.col(x), F.lit(None)).alias(x) for x in pdf.columns[1:]])
    return pdf, sdf


def test_gram_matches_pandas_pairwise(spark):
    pdf, sdf = _fixture(spark)
    cols = ["a", "b", "c", "neg", "const", "holes"]
    got = {(r.col_i, r.col_j): r.r for r in pairwise_corr(sdf, cols, tasks=3).collect()}
    ref = pdf[cols].corr()
    for (i, j), r in got.items():
        e = ref.loc[i, j]
        if np.isnan(e):
            assert r is None, (i, j)
        else:
            assert abs(r - e) < 1e-12, (i, j, r, e)
    assert len(got) == len(cols) * (len(cols) - 1) // 2


def test_aggregate_path_equals_gram(spark):
    _, sdf = _fixture(spark)
    cols = ["a", "b", "c", "neg", "const", "holes"]
    g = {(r.col_i, r.col_j): r.r for r in pairwise_corr(sdf, cols).collect()}
    a = {(r.col_i, r.col_j): r.r for r in pairwise_corr_agg(sdf, cols).collect()}
    assert g.keys() == a.keys()
    for k in g:
        assert (g[k] is None and a[k] is None) or abs(g[k] - a[k]) < 1e-12


def test_collinear_cut_order_and_sign(spark):
    pdf, sdf = _fixture(spark)
    cols = ["a", "b", "c", "neg"]
    r = pdf[cols].corr()
    assert r.loc["a", "b"] > 0.8 and r.loc["b", "c"] > 0.8 and r.loc["a", "neg"] < -0.8
    removed = {x.feature for x in collinear_drop(pairwise_corr(sdf, cols), 0.8).collect()}
    expected = {cols[j] for j in range(len(cols)) for i in range(j) if r.iloc[i, j] > 0.8}
    assert removed == expected and "neg" not in removed and "b" in removed


def test_top_bottom_nulls_last(spark):
    df = spark.createDataFrame([("x", 0.5), ("y", None), ("z", -0.2), ("w", 0.1)], "feature string, r double")
    tb = {(x.side, x.rank): x.feature for x in top_bottom(df, 2).collect()}
    assert tb == {("top", 1): "x", ("top", 2): "w", ("bottom", 1): "z", ("bottom", 2): "w"}


def test_fit_selection_matches_topk_query(spark):
    import __spark_entry__ as E
    from riskweave.operators.select import fit_selection
    from riskweave.plans import entities as EN
    sf = "/root/testdata/sf0.01"
    spec = fit_selection(EN.doc_features(spark, sf), "TARGET", "SK_ID_CURR", k=10)
    expected = {r.feature for r in E.queries()["q_topk_features"](spark, sf).collect()}
    assert set(spec.keep) == expected | {"SK_ID_CURR", "TARGET"}
    out = spec.transform(EN.doc_features(spark, sf))
    assert set(out.columns) == set(spec.keep)


def test_tiles_and_levels_equal_pandas(spark):
    """Many tiles, and more tasks than one level adds up; columns far from zero, all missing or constant in a task."""
    rng = np.random.default_rng(11)
    n, p = 400, 37
    base = rng.normal(size=(n, 5))
    pdf = pd.DataFrame({f"x{k}": base[:, k % 5] * (1 + k) + rng.normal(size=n) * 0.5 + 1e4 * (k % 3) for k in range(p)})
    pdf = pdf.mask(rng.random((n, p)) < 0.2)
    pdf.loc[:100, "x3"] = np.nan
    pdf.loc[100:, "x4"] = 7.0
    sdf = spark.createDataFrame(pdf).select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in pdf.columns]).repartition(11)
    ref = pdf.corr()
    for tile, fan_in in ((5, 3), (8, 16), (37, 2), (64, 16)):
        got = {(r.pos_i, r.pos_j): r for r in pairwise_corr(sdf, list(pdf.columns), tasks=11, tile=tile, fan_in=fan_in, include_diagonal=True).collect()}
        assert len(got) == p * (p + 1) // 2
        for (i, j), r in got.items():
            both = pdf.iloc[:, i].notna() & pdf.iloc[:, j].notna()
            assert r.n == both.sum() and (r.col_i, r.col_j) == (f"x{i}", f"x{j}")
            e = ref.iloc[i, j]
            assert (r.r is None) if np.isnan(e) else abs(r.r - e) < 1e-9


def test_packed_rows_follow_the_tasks_not_the_input(spark):
    from riskweave.operators.correlate import _strip, packed_sums
    sdf = spark.range(0, 3000, 1, 60).select(*[(F.col("id") % (k + 2)).cast("double").alias(f"c{k}") for k in range(9)])
    assert packed_sums(sdf, sdf.columns, tasks=4, tile=4).count() == 6  # three tiles
    assert sdf.select("c0").coalesce(4).mapInPandas(_strip(0, 1, 4), "i int, j int, part int, a binary, b binary, sums binary").count() == 4


def test_empty_table(spark):
    sdf = spark.createDataFrame([], "a double, b double")
    assert pairwise_corr(sdf).collect() == []


def test_a_strip_copies_few_values_at_a_time(spark):
    """One batch of 40,000 x 200 values is folded in slices: the peak of numpy's memory stays far below the batch."""
    import tracemalloc

    from pyspark import TaskContext

    from riskweave.operators import correlate as C
    p, n = 200, 40_000
    rng = np.random.default_rng(3)
    X = rng.normal(size=(n, p))
    X[X > 2.5] = np.nan
    batch = pd.DataFrame(X, columns=[f"c{k}" for k in range(p)])

    class Task:
        @staticmethod
        def partitionId():
            return 0
    was, TaskContext.get = TaskContext.get, staticmethod(lambda: Task)
    try:
        tracemalloc.start()
        row, = (r for b in C._strip(0, p, 256)(iter([batch])) for r in b.to_dict("records"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        TaskContext.get = was
    assert peak < X.nbytes / 2
    n_ij = np.frombuffer(row["sums"]).reshape(6, p, p)[0]
    seen = (~np.isnan(X)).astype(float)
    assert (n_ij == seen.T @ seen).all()
