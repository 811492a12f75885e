"""Learned side of missing values, staged grid search, saved parameters."""

import itertools

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.learn import train as L


@pytest.fixture(scope="module")
def rows(spark):
    """y follows x: small and missing values are 1. The mean of the known values is on the wrong side."""
    df = spark.range(600).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("u"),
                                 (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0).alias("z"))
    df = df.withColumn("x", F.when(F.col("u") < 0.3, F.lit(None)).when(F.col("u") < 0.32, F.lit(float("nan"))).otherwise(F.col("u")))
    return df.withColumn("y", (F.col("u") < 0.5).cast("int")).withColumn("fold", (F.col("k") % 3).cast("int")).cache()


def test_every_split_learns_its_side(spark, rows):
    for turned in (False, True):  # missing rows belong to the small values, then to the large ones
        df = rows.withColumn("x", -F.col("x")) if turned else rows
        model = L.fit(df, ["x"], "y", maxIter=1, maxDepth=1, stepSize=1.0, subsamplingRate=1.0)
        assert not any("Imputer" in type(s).__name__ for s in model.stages)
        wrong = L.predict(model, df, ["k", "y"]).where("prediction <> y").count()
        assert wrong <= 600 * 0.02  # the split falls between two of 32 bins
    assert L.nullable_columns(rows, ["x", "z"]) == ["x"]


def test_source_columns():
    stages, inputs = L.side_stages(["a", "b_low", "c"], ["a", "c"])
    assert inputs == ["a_low", "a_high", "b_low", "c_low", "c_high"] and len(stages) == 1
    assert L.source_columns(inputs, ["a", "b_low", "c"]) == ["a", "a", "b_low", "c", "c"]


def test_prefix_scores_equal_separate_fits(spark, rows):
    grid = {"minWeightFractionPerNode": [0.0005, 0.1], "maxDepth": [2, 3], "featureSubsetStrategy": ["0.6"], "maxIter": [2, 4]}
    model, best, res = L.grid_search(rows, ["x", "z"], "y", grid, k=3, parallelism=3)
    got = {r["grid_index"]: r for r in res.collect()}
    assert len(got) == 8 and sum(r["is_best"] for r in got.values()) == 1
    points = L.grid_points(grid)
    for i in (0, 3, 6):  # fitted on their own
        each = []
        for f in range(3):
            data = L.prepare(rows, "y", L.class_weights(rows, "y")).where(F.col("fold") != f)
            m = L.build_pipeline(["x", "z"], "y", ["x"], "weight", **points[i]).fit(data)
            p = L.predict(m, rows.where(F.col("fold") == f), ["y"])
            c = p.agg(*[F.count_if((F.col("y") == a) & (F.col("prediction") == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))]).first()
            each.append(L.fbeta(c["tp"], c["fp"], c["fn"], 10.0))
        assert got[i]["mean_fbeta"] == pytest.approx(sum(each) / 3, abs=1e-12)
    # the refit has the chosen parameters, and keeps them when it is trained again from what is saved
    params = L.model_params(model)
    assert {n: params[n] for n in best} == best and params["balance"] is True
    again = L.fit(rows, ["x", "z"], "y", **params)
    assert L.model_params(again) == params
    a, b = (m.transform(rows).select("k", vector_to_array("rawPrediction")[1].alias("m")).orderBy("k").collect() for m in (model, again))
    assert a == b


def test_the_whole_grid_is_accepted_with_few_trees(spark, rows):
    """All combinations of the full grid but for the numbers of trees, which are cut to keep the test short."""
    few = dict(L.REFERENCE_GRID, maxIter=[1, 2], maxDepth=[3, 5], minInstancesPerNode=[50], minWeightFractionPerNode=[0.0005, 0.002])
    _, _, res = L.grid_search(rows, ["x", "z"], "y", few, k=2, parallelism=4)
    assert res.count() == len(list(itertools.product(*few.values())))
    assert len(L.grid_points(L.REFERENCE_GRID)) == 108


def test_fit_tasks_follow_the_rows(spark, rows):
    """600 rows in 40 partitions are fitted in one partition, not by 40 tasks a level of every tree."""
    sc = spark.sparkContext
    split = rows.repartition(40)
    assert L.sized(split, 600).rdd.getNumPartitions() == 1
    assert L.sized(split, 2 * L.ROWS_A_TASK + 1).rdd.getNumPartitions() == 3
    sc.setJobGroup("sized-fit", "")
    try:
        L.fit(split, ["z"], "y", nullable=[], maxIter=3, maxDepth=2)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("sized-fit") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 250  # a stage of 40 and one a level before
