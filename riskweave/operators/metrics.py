"""Classification metrics over (label, score) tables (ML7-ML13).

Nothing here sorts raw rows globally: counts are aggregated per distinct score (or
per threshold bucket) first, and cumulative sums over the distinct scores use range
partitions with per-partition offsets."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import cut_lineage


def sweep_thresholds(start: float = 0.05, stop: float = 0.95, step: float = 0.01) -> list[float]:
    """The exact doubles of ``numpy.arange(start, stop, step)``."""
    return [float(t) for t in np.arange(start, stop, step)]


def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: tp, fp, fn, tn."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def _safe(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def fbeta_expr(tp, fp, fn, beta: float) -> "F.Column":
    """F-beta from counts; zero division -> 0."""
    b2 = float(beta) ** 2
    return _safe(F.lit(1.0 + b2) * tp, F.lit(1.0 + b2) * tp + F.lit(b2) * fn + fp)


def metrics_from_counts(counts: DataFrame, beta: float = 10.0) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
        _safe(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
        _safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        fbeta_expr(tp, fp, fn, beta).alias("fbeta"))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """2x2 (actual, predicted, n) — always 4 rows (unpivot of one aggregate row)."""
    c = confusion_counts(df, label, pred)
    return c.select(F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) AS (actual, predicted, n)"))


def missing_last(score: str):
    """The score as a double; a missing one (NULL, NaN) is below every threshold, in every metric."""
    x = F.col(score).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float("-inf"))).otherwise(x)


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score; missing scores are one score below all."""
    return df.groupBy(missing_last(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def cumulative(df: DataFrame, order_col: str, cols: list[str], descending: bool = False,
               partitions: int | None = None, following: bool = False) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` in ``order_col`` order; with ``following`` also ``next_<c>``, the value of
    the next row (NULL at the last one), carried over the borders of the ranges.

    The input is already aggregated (e.g. one row per distinct score). Rows are
    range-partitioned and carry the number of their range as a column, fixed by a
    checkpoint; a window runs inside each range and the sums of the ranges before it
    (one row per range) are joined on that column. The result does not depend on
    how its partitions are merged later."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranged = cut_lineage(df.repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    first = F.max_by if descending else F.min_by
    offsets = (ranged.groupBy(F.col("_range").alias("_r")).agg(*[F.sum(F.col(c).cast("double")).alias(f"_t_{c}") for c in cols],
                                                               *[first(c, order_col).alias(f"_f_{c}") for c in cols])
               .select("_r", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0.0)).alias(f"_o_{c}") for c in cols],
                       *[F.lead(f"_f_{c}").over(Window.orderBy("_r")).alias(f"_n_{c}") for c in cols]))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = Window.partitionBy("_range").orderBy(key)
    local = ranged.select("*", *[F.sum(F.col(c).cast("double")).over(inside).alias(f"_l_{c}") for c in cols],
                          *[F.lead(c).over(steps).alias(f"_i_{c}") for c in cols if following])
    return local.join(offsets, F.col("_range") == F.col("_r")).select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"cum_{c}") for c in cols],
        *[F.coalesce(f"_i_{c}", f"_n_{c}").alias(f"next_{c}") for c in cols if following])


def roc_points(df: DataFrame, label: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """ML10: (threshold, tpr, fpr), thresholds descending from the start point (+inf, 0, 0). With
    ``drop_intermediate`` a point whose step to the next one equals the step that led to it is left out, but for
    the first and the last score. Missing scores are the last threshold (-inf); a class without rows has rate 0."""
    sc = score_counts(df, label, score)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max("score").alias("top")).first()  # one row
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    cum = cumulative(sc, "score", ["pos", "neg"], descending=True, following=drop_intermediate)
    if drop_intermediate:
        straight = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg")) & (F.col("score") != F.lit(tot["top"]))
        cum = cum.where(~F.coalesce(straight, F.lit(False)))
    points = cum.select(F.col("score").alias("threshold"),
                        (F.col("cum_pos") / P if P else F.lit(0.0)).alias("tpr"),
                        (F.col("cum_neg") / N if N else F.lit(0.0)).alias("fpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, tpr double, fpr double")
    return start.unionByName(points)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ML7 exact, tie-aware AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N);
    NULL when only one class is present. Missing scores rank lowest."""
    sc = score_counts(df, label, score)
    cum = cumulative(sc, "score", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def youden(roc: DataFrame) -> DataFrame:
    """ML11: argmax(tpr - fpr); the first maximum in descending-threshold order, so +inf where no score beats the start."""
    j = roc.withColumn("j", F.col("tpr") - F.col("fpr"))
    best = j.agg(F.max_by(F.struct("threshold", "tpr", "fpr", "j"),
                          F.struct(F.col("j"), F.col("threshold"))).alias("b"))
    return best.select("b.*")


def threshold_sweep(df: DataFrame, label: str, score: str, beta: float = 10.0,
                    thresholds: list[float] | None = None) -> DataFrame:
    """ML12: F-beta at every threshold (prediction = score >= t) in one pass: a
    Bucketizer on the exact threshold doubles ([a, b) buckets, i.e. >=), counts per
    (bucket, label), suffix sums over <= len(thresholds)+1 rows."""
    ts = thresholds or sweep_thresholds()
    bk = Bucketizer(splits=[-float("inf")] + ts + [float("inf")], inputCol=score, outputCol="_b",
                    handleInvalid="keep")
    counts = (bk.transform(df.select(F.col(label).alias("y"), missing_last(score).alias(score)))
              .groupBy("_b").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))
    spark = df.sparkSession
    tdf = spark.createDataFrame([(k + 1, t) for k, t in enumerate(ts)], "_b int, threshold double")
    # rows with bucket >= k+1 have score >= t_k; every frame below spans <= len(ts)+1 rows
    allb = tdf.join(counts, "_b", "full").na.fill({"pos": 0, "neg": 0})
    w = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    s = allb.select("_b", "threshold", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                    F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    s = s.where(F.col("threshold").isNotNull()).select(
        "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return s.withColumn("fbeta", fbeta_expr(F.col("tp").cast("double"), F.col("fp").cast("double"),
                                            F.col("fn").cast("double"), beta))


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """The first threshold (ascending) with strictly the best F-beta; ``default``
    (score 0) when no threshold scores above 0. One aggregate, no join."""
    b = sweep.agg(F.max_by("threshold", F.struct(F.col("fbeta"), -F.col("threshold"))).alias("t"),
                  F.max("fbeta").alias("m"))
    return b.select(F.when(F.col("m") > 0, F.col("t")).otherwise(F.lit(default)).alias("best_threshold"),
                    F.coalesce(F.when(F.col("m") > 0, F.col("m")), F.lit(0.0)).alias("best_fbeta"))


def apply_threshold(df: DataFrame, score: str, threshold: float, out: str = "prediction") -> DataFrame:
    """ML13: prediction = score >= threshold (evaluation rule)."""
    return df.withColumn(out, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def exact_lower_quantile(df: DataFrame, col: str, q: float = 0.5):
    """Exact lower quantile (the value at 1-based rank max(1, ceil(q*n)) among the
    non-null values; q=0.5 gives the lower median). Counts per distinct value, then
    range-partitioned cumulative counts: no value list reaches one task or the
    driver, only the answer does."""
    import math
    vals = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = vals.agg(F.sum("c")).first()[0]
    if not n:
        return None
    k = max(1, math.ceil(q * n))
    cum = cumulative(vals, "v", ["c"])
    return cum.where(F.col("cum_c") >= k).agg(F.min("v")).first()[0]
