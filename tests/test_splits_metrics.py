"""Sampling / folds / metrics properties on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import metrics as M
from riskweave.operators.split import hash_sample, stratified_folds, stratified_split


def _labels(spark, n=503, pos_every=7):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % pos_every == 0).cast("int").alias("y"))


def test_folds_balanced_within_one(spark):
    f = stratified_folds(_labels(spark), "k", "y", 5)
    c = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in c if r.y == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_split_exact_and_deterministic(spark):
    s1 = stratified_split(_labels(spark), "k", "y")
    s2 = stratified_split(_labels(spark).repartition(7), "k", "y")
    a = sorted(tuple(r) for r in s1.collect())
    assert a == sorted(tuple(r) for r in s2.collect())
    n = {r.y: r["count"] for r in _labels(spark).groupBy("y").count().collect()}
    tr = {r.y: r["count"] for r in s1.where("split = 'train'").groupBy("y").count().collect()}
    assert all(tr[y] == int(np.floor(n[y] * 0.6)) for y in n)


def test_hash_sample_fraction(spark):
    s = hash_sample(spark.range(20000).withColumnRenamed("id", "k"), "k", 0.2)
    assert abs(s.count() / 20000 - 0.2) < 0.02


def test_sweep_uses_ge_and_first_best(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.1), (0, 0.1), (0, 0.5), (1, 0.5), (0, 0.05)], "y int, s double")
    sw = {round(r.threshold, 2): r for r in M.threshold_sweep(df, "y", "s").collect()}
    assert sw[0.1].tp == 3 and sw[0.1].fp == 2  # 0.1 + 5*0.01 == 0.1 exactly: score 0.1 counts (>=)
    best = M.best_threshold(M.threshold_sweep(df, "y", "s")).first()
    assert round(best.best_threshold, 2) == min(t for t, r in sw.items() if r.fbeta == max(x.fbeta for x in sw.values()))


def test_auc_ties_and_roc(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.2), (0, 0.6), (1, 0.9)], "y int, s double")
    auc = M.roc_auc(df, "y", "s").first().auc
    pos, neg = [0.8, 0.6, 0.9], [0.8, 0.2, 0.6]
    exp = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / 9
    assert abs(auc - exp) < 1e-12
    roc = sorted((r.threshold, r.tpr, r.fpr) for r in M.roc_points(df, "y", "s").collect())
    assert roc[-1] == (float("inf"), 0.0, 0.0) and roc[-2] == (0.9, 1 / 3, 0.0) and roc[0] == (0.2, 1.0, 1.0)
    y = M.youden(M.roc_points(df, "y", "s")).first()
    assert abs(y.j - max(t - f for _, t, f in roc)) < 1e-12


def test_confusion_four_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    cm = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df, "y", "p").collect()}
    assert cm == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    m = M.metrics_from_counts(M.confusion_counts(df, "y", "p")).first()
    assert m.precision == 1.0 and m.fbeta == 1.0
    z = M.metrics_from_counts(M.confusion_counts(df.withColumn("p", F.lit(0)), "y", "p")).first()
    assert z.precision == 0.0 and z.fbeta == 0.0


def test_running_sums_survive_coalesce_and_union(spark):
    df = spark.range(1000).select(F.col("id").alias("s"), F.lit(1).alias("v"))
    cum = M.cumulative(df, "s", ["v"], partitions=8)
    want = {i: float(i + 1) for i in range(1000)}
    assert {r.s: r.cum_v for r in cum.collect()} == want
    assert {r.s: r.cum_v for r in cum.coalesce(1).collect()} == want
    assert cum.union(cum).agg(F.sum("cum_v")).first()[0] == 2 * sum(want.values())
    down = {r.s: r.cum_v for r in M.cumulative(df, "s", ["v"], descending=True, partitions=4).coalesce(1).collect()}
    assert down == {i: float(1000 - i) for i in range(1000)}


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.3)], "y int, s double")
    r = M.roc_auc(df, "y", "s").first()
    assert r.auc is None and (r.n_pos, r.n_neg) == (2, 0)


def test_missing_scores_are_never_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0.99), (0, float("nan")), (1, None), (0, 0.0)], "y int, s double")
    for r in M.threshold_sweep(df, "y", "s").collect():
        assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2)


def test_null_labels_are_ranked(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(20)], "k long, y int")
    n = {r.split: r["count"] for r in stratified_split(df, "k", "y").groupBy("split").count().collect()}
    assert n == {"train": 12, "val": 4, "test": 4}
