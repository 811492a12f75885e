"""ROC curve: start point, straight stretches across range borders, missing scores, scores opposite to the labels."""

import math
import random

from riskweave.operators import metrics as M

INF = float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "y int, s double")


def brute(rows, drop=True):
    low = lambda s: -INF if s is None or math.isnan(s) else s
    scores = sorted({low(s) for _, s in rows}, reverse=True)
    steps = [(sum(y == 1 and low(s) == t for y, s in rows), sum(y == 0 and low(s) == t for y, s in rows)) for t in scores]
    P, N = sum(p for p, _ in steps), sum(n for _, n in steps)
    out, tp, fp = [(INF, 0.0, 0.0)], 0, 0
    for k, (t, (p, n)) in enumerate(zip(scores, steps)):
        tp, fp = tp + p, fp + n
        if not drop or k in (0, len(steps) - 1) or steps[k + 1] != (p, n):
            out.append((t, tp / P if P else 0.0, fp / N if N else 0.0))
    return out


def points(spark, rows, **more):
    got = [tuple(r) for r in M.roc_points(table(spark, rows), "y", "s", **more).collect()]
    return sorted(got, key=lambda r: -r[0])


def test_points_equal_brute_force(spark):
    rng = random.Random(1)
    cases = [[(rng.randint(0, 1), rng.choice([None, float("nan"), round(rng.random(), 2)])) for _ in range(n)] for n in (1, 2, 5, 60, 400)]
    cases.append([(1, i / 100) for i in range(50)] + [(0, i / 100 + 0.5) for i in range(50)])  # long straight stretches over all ranges
    for rows in cases:
        for drop in (True, False):
            want, got = brute(rows, drop), points(spark, rows, drop_intermediate=drop)
            assert [w[0] for w in want] == [g[0] for g in got]
            assert all(math.isclose(a, b, abs_tol=1e-12) for w, g in zip(want, got) for a, b in zip(w, g) if not math.isinf(a))
    assert len(points(spark, cases[-1])) <= 6


def test_start_point_wins_against_opposite_scores(spark):
    best = M.youden(M.roc_points(table(spark, [(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)]), "y", "s")).first()
    assert (best["threshold"], best["tpr"], best["fpr"], best["j"]) == (INF, 0.0, 0.0, 0.0)
    best = M.youden(M.roc_points(table(spark, [(1, 0.9), (0, 0.8), (1, 0.2)]), "y", "s")).first()
    assert best["threshold"] == 0.9


def test_missing_scores_rank_lowest_everywhere(spark):
    rows = [(1, None), (1, float("nan")), (1, 0.5), (0, 0.4), (0, 0.1)]
    assert M.roc_auc(table(spark, rows), "y", "s").first()["auc"] == 2 / 6
    assert points(spark, rows)[-1][0] == -INF
    low = M.threshold_sweep(table(spark, rows), "y", "s").orderBy("threshold").first()
    assert (low["tp"], low["fn"]) == (1, 2)


def test_empty_and_one_class(spark):
    assert points(spark, []) == [(INF, 0.0, 0.0)]
    assert [p[1:] for p in points(spark, [(1, 0.2), (1, 0.4)])] == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
