"""Registered queries: sampling, splits, folds, class weights and classification
metrics over a deterministic score of the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.scalar import round_doubles
from riskweave.operators import metrics as M
from riskweave.operators.split import hash_sample, stratified_folds, stratified_split
from riskweave.plans import entities as E
from riskweave.plans import roles
from riskweave.plans import sqlgen as S
from riskweave.plans.catalog import register

KEY, LABEL = E.KEY, E.LABEL
BETA = 10.0
FRACTIONS = (0.6, 0.2, 0.2)


hash_sql = S.hash_sql
LAB_CTE = "lab AS (SELECT SK_ID_CURR, TARGET FROM documents_entity WHERE TARGET IS NOT NULL)"
SCORED_CTE = (f"scored AS (SELECT SK_ID_CURR, TARGET, floor((CAST(0.6 AS DOUBLE) * {hash_sql('SK_ID_CURR', 1)}"
              f" + CAST(0.4 AS DOUBLE) * TARGET * {hash_sql('SK_ID_CURR', 2)}) * 100) / 100 AS SCORE FROM lab)")


def _with_scored(*extra):
    return S.with_roles("documents_entity", extra=[LAB_CTE, SCORED_CTE, *extra])


# ---------------------------------------------------------------- sampling
@register("q_sample_hash", S.with_roles("documents_entity", extra=[LAB_CTE])
          + f"SELECT SK_ID_CURR, TARGET FROM lab WHERE {hash_sql('SK_ID_CURR', 42)} < 0.2")
def q_sample_hash(spark, d):
    """SMP1: deterministic 20 % sample (seed 42) of the labelled rows."""
    lab = E.labelled(roles.documents_entity(spark, d)).select(KEY, LABEL)
    return hash_sample(lab, KEY, 0.2, seed=42)


_RANKED = (f"ranked AS (SELECT SK_ID_CURR, TARGET, row_number() OVER (PARTITION BY TARGET ORDER BY "
           f"{hash_sql('SK_ID_CURR', 42)}, SK_ID_CURR) AS rnk, count(*) OVER (PARTITION BY TARGET) AS n FROM lab)")


@register("q_strat_split", S.with_roles("documents_entity", extra=[LAB_CTE, _RANKED]) + f"""
SELECT SK_ID_CURR, TARGET, CASE WHEN rnk <= floor(n * {FRACTIONS[0]!r}) THEN 'train'
  WHEN rnk <= floor(n * {FRACTIONS[0] + FRACTIONS[1]!r}) THEN 'val' ELSE 'test' END AS split FROM ranked""")
def q_strat_split(spark, d):
    """SMP2: exact stratified 60/20/20 split (seed 42), ranks by bucketed windows."""
    lab = E.labelled(roles.documents_entity(spark, d)).select(KEY, LABEL)
    return stratified_split(lab, KEY, LABEL, FRACTIONS, seed=42)


@register("q_folds", S.with_roles("documents_entity", extra=[LAB_CTE, _RANKED])
          + "SELECT SK_ID_CURR, TARGET, CAST((rnk - 1) % 5 AS INTEGER) AS fold FROM ranked")
def q_folds(spark, d):
    """SMP3: stratified 5-fold assignment (seed 42)."""
    lab = E.labelled(roles.documents_entity(spark, d)).select(KEY, LABEL)
    return stratified_folds(lab, KEY, LABEL, 5, seed=42)


@register("q_class_weights", S.with_roles("documents_entity", extra=[LAB_CTE]) + """
SELECT TARGET, n, CASE WHEN TARGET = 1 THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1.0 END AS weight
FROM (SELECT TARGET, count(*) AS n FROM lab GROUP BY TARGET) c,
     (SELECT count(*) FILTER (WHERE TARGET = 1) AS n_pos, count(*) FILTER (WHERE TARGET = 0) AS n_neg FROM lab) t""")
def q_class_weights(spark, d):
    """ML2: class-imbalance weights (positive weight = n_neg / n_pos)."""
    from riskweave.learn.train import class_weights
    lab = E.labelled(roles.documents_entity(spark, d)).select(KEY, LABEL)
    w = class_weights(lab, LABEL)
    counts = lab.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(LABEL, "n", F.when(F.col(LABEL) == 1, F.lit(w[1])).otherwise(F.lit(w[0])).alias("weight"))


# ---------------------------------------------------------------- metrics
def _fb(tp, fp, fn):
    b2 = BETA ** 2
    return (f"CASE WHEN {1 + b2!r} * {tp} + {b2!r} * {fn} + {fp} > 0 THEN {1 + b2!r} * {tp} / "
            f"({1 + b2!r} * {tp} + {b2!r} * {fn} + {fp}) ELSE 0.0 END")


def _safe(n, dd):
    return f"CASE WHEN ({dd}) > 0 THEN ({n}) / ({dd}) ELSE 0.0 END"


_COUNTS = ("counts AS (SELECT CAST(count(*) FILTER (WHERE TARGET = 1 AND pred = 1) AS BIGINT) AS tp,\n"
           "  CAST(count(*) FILTER (WHERE TARGET = 0 AND pred = 1) AS BIGINT) AS fp,\n"
           "  CAST(count(*) FILTER (WHERE TARGET = 1 AND pred = 0) AS BIGINT) AS fn,\n"
           "  CAST(count(*) FILTER (WHERE TARGET = 0 AND pred = 0) AS BIGINT) AS tn\n"
           "  FROM (SELECT TARGET, CAST(SCORE >= 0.5 AS INTEGER) AS pred FROM scored) p)")


def _metrics_sql():
    tp, fp, fn, tn = ("CAST(tp AS DOUBLE)", "CAST(fp AS DOUBLE)", "CAST(fn AS DOUBLE)", "CAST(tn AS DOUBLE)")
    cols = [f"{S.r6(_safe(tp, f'{tp} + {fp}'))} AS precision", f"{S.r6(_safe(tp, f'{tp} + {fn}'))} AS recall",
            f"{S.r6(_safe(f'2.0 * {tp}', f'2.0 * {tp} + {fp} + {fn}'))} AS f1",
            f"{S.r6(_safe(f'{tp} + {tn}', f'{tp} + {fp} + {fn} + {tn}'))} AS accuracy",
            f"{S.r6(_fb(tp, fp, fn))} AS fbeta"]
    return _with_scored(_COUNTS) + "SELECT tp, fp, fn, tn,\n  " + ",\n  ".join(cols) + "\nFROM counts"


@register("q_counts_metrics", _metrics_sql)
def q_counts_metrics(spark, d):
    """ML7/ML8: counts, precision, recall, F1, accuracy, F-beta(10) at 0.5 (>=)."""
    sc = M.apply_threshold(E.scored_labels(spark, d), "SCORE", 0.5)
    return round_doubles(M.metrics_from_counts(M.confusion_counts(sc, LABEL, "prediction"), BETA))


@register("q_confusion", _with_scored(_COUNTS) + """
SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)
JOIN (SELECT 0 AS a, 0 AS p, tn AS n FROM counts UNION ALL SELECT 0, 1, fp FROM counts
      UNION ALL SELECT 1, 0, fn FROM counts UNION ALL SELECT 1, 1, tp FROM counts) c
ON v.actual = c.a AND v.predicted = c.p""".replace("SELECT * FROM", "SELECT actual, predicted, n FROM"))
def q_confusion(spark, d):
    """ML9: 2x2 confusion counts (always four cells)."""
    sc = M.apply_threshold(E.scored_labels(spark, d), "SCORE", 0.5)
    return M.confusion_matrix(sc, LABEL, "prediction")


_SCORE_COUNTS = ("sc AS (SELECT SCORE AS score, count(*) FILTER (WHERE TARGET = 1) AS pos,\n"
                 "  count(*) FILTER (WHERE TARGET = 0) AS neg FROM scored GROUP BY SCORE)")


@register("q_auc", _with_scored(_SCORE_COUNTS, """cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc)""") + f"""
SELECT {S.r6('sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))')} AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cum""")
def q_auc(spark, d):
    """ML7: exact tie-aware ROC-AUC from per-score counts and range-partitioned
    cumulative sums."""
    return round_doubles(M.roc_auc(E.scored_labels(spark, d), LABEL, "SCORE"))


_ROC = ("steps AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS k FROM sc WINDOW w AS (ORDER BY score DESC)),\n"
        "roc AS (SELECT threshold, tpr, fpr FROM (SELECT score AS threshold, k, np, nn, pos, neg,\n"
        "  CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(pos) OVER () AS tpr,\n"
        "  CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(neg) OVER () AS fpr\n"
        "  FROM steps) p WHERE k = 1 OR np IS NULL OR np <> pos OR nn <> neg\n"
        "  UNION ALL SELECT CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE))")


@register("q_roc_points", _with_scored(_SCORE_COUNTS, _ROC)
          + f"SELECT threshold, {S.r6('tpr')} AS tpr, {S.r6('fpr')} AS fpr FROM roc")
def q_roc_points(spark, d):
    """ML10: ROC points (threshold, tpr, fpr) from the start point on, without points on a straight line."""
    return round_doubles(M.roc_points(E.scored_labels(spark, d), LABEL, "SCORE"))


_OPPOSITE = "opposite AS (SELECT SK_ID_CURR, 1 - TARGET AS TARGET, SCORE FROM scored)"


@register("q_youden_opposite", _with_scored(_OPPOSITE, _SCORE_COUNTS.replace("FROM scored", "FROM opposite"), _ROC)
          + f"SELECT threshold, {S.r6('tpr')} AS tpr, {S.r6('fpr')} AS fpr, {S.r6('tpr - fpr')} AS j "
            "FROM roc ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1")
def q_youden_opposite(spark, d):
    """ML11 on labels turned round: the scores lean the wrong way, so the start point can win."""
    turned = E.scored_labels(spark, d).withColumn(LABEL, 1 - F.col(LABEL))
    return round_doubles(M.youden(M.roc_points(turned, LABEL, "SCORE")))


@register("q_youden", _with_scored(_SCORE_COUNTS, _ROC)
          + f"SELECT threshold, {S.r6('tpr')} AS tpr, {S.r6('fpr')} AS fpr, {S.r6('tpr - fpr')} AS j "
            "FROM roc ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1")
def q_youden(spark, d):
    """ML11: Youden-optimal threshold (first maximum of tpr - fpr, descending)."""
    return round_doubles(M.youden(M.roc_points(E.scored_labels(spark, d), LABEL, "SCORE")))


def _sweep_ctes():
    vals = ", ".join(f"(CAST('{t!r}' AS DOUBLE))" for t in M.sweep_thresholds())
    thr = f"thr(threshold) AS (VALUES {vals})"
    sw = ("sw AS (SELECT threshold, count(*) FILTER (WHERE TARGET = 1 AND SCORE >= threshold) AS tp,\n"
          "  count(*) FILTER (WHERE TARGET = 0 AND SCORE >= threshold) AS fp,\n"
          "  count(*) FILTER (WHERE TARGET = 1 AND SCORE < threshold) AS fn,\n"
          "  count(*) FILTER (WHERE TARGET = 0 AND SCORE < threshold) AS tn\n"
          "  FROM thr, scored GROUP BY threshold)")
    fb = ("swf AS (SELECT *, " + _fb("CAST(tp AS DOUBLE)", "CAST(fp AS DOUBLE)", "CAST(fn AS DOUBLE)")
          + " AS fbeta FROM sw)")
    best = ("best AS (SELECT CASE WHEN max(fbeta) > 0 THEN min(threshold) FILTER (WHERE fbeta = m) ELSE 0.5 END"
            " AS best_threshold FROM swf, (SELECT max(fbeta) AS m FROM swf) mm)")
    return [thr, sw, fb, best]


@register("q_threshold_sweep", lambda: _with_scored(*_sweep_ctes())
          + f"SELECT {S.r6('threshold')} AS threshold, tp, fp, fn, tn, {S.r6('fbeta')} AS fbeta FROM swf")
def q_threshold_sweep(spark, d):
    """ML12: F-beta(10) at the 90 thresholds 0.05..0.94 (score >= t)."""
    return round_doubles(M.threshold_sweep(E.scored_labels(spark, d), LABEL, "SCORE", BETA))


@register("q_apply_threshold", lambda: _with_scored(*_sweep_ctes()) + """
SELECT SK_ID_CURR, TARGET, SCORE, (round(best_threshold * 1e6 - CAST(0.3767 AS DOUBLE)) / 1e6 + 0.0) AS best_threshold,
  CAST(SCORE >= best_threshold AS INTEGER) AS prediction,
  CAST(SCORE > best_threshold AS INTEGER) AS decision_default
FROM scored, best""")
def q_apply_threshold(spark, d):
    """ML13 vs SC2: the tuned threshold applied with >= (evaluation) and with
    strict > (decision); the two differ exactly where score == threshold."""
    sc = E.scored_labels(spark, d)
    best = M.best_threshold(M.threshold_sweep(sc, LABEL, "SCORE", BETA)).first()["best_threshold"]
    out = M.apply_threshold(sc, "SCORE", best)
    return round_doubles(out.select(KEY, LABEL, "SCORE", F.lit(best).alias("best_threshold"), "prediction",
                                    (F.col("SCORE") > F.lit(best)).cast("int").alias("decision_default")))
