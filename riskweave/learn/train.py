"""Training side (ML1-ML6, ML14-ML15): class weights, missing values on a learned side of
every split (or imputed, with NULL indicators), the gradient-boosted tree pipeline, grid search over
stratified folds with staged scores, cross-validation report, refit with carried-over threshold, run records.

All fitting is Spark ML (distributed histogram trees); the driver only sees
parameters and metric rows."""

from __future__ import annotations

import json
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import metrics as M
from riskweave.session import cut_lineage
from riskweave.sources.registry import append_rows

# Learner settings of the reference mapped to Spark ML names.
BASE_PARAMS = {"stepSize": 0.01, "subsamplingRate": 0.9, "seed": 42}
# The full grid as Spark parameters (num_leaves has no equivalent; the smallest child
# weight is a share of all weights here). Any subset can be passed to ``grid_search``.
REFERENCE_GRID = {
    "minWeightFractionPerNode": [0.0005, 0.001, 0.002],
    "minInstancesPerNode": [50, 100, 150],
    "maxDepth": [3, 5, 7],
    "maxIter": [300, 500],
    "featureSubsetStrategy": ["0.6", "0.8"],
}
# Stand-ins of a missing value below and above all values: a nullable column enters the trees once with each.
BELOW, ABOVE = -1e300, 1e300
SIDES = ("_low", "_high")
ROWS_A_TASK = 20_000  # rows of a partition that trees are fitted on
METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "auc", "fbeta"]


def label_counts(df: DataFrame, label: str) -> dict[int, int]:
    """One grouped count; one row per class reaches the driver."""
    return {int(r[label]): int(r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def class_weights(df: DataFrame, label: str, counts: dict[int, int] | None = None) -> dict[int, float]:
    """ML2 (``is_unbalance``): positive weight n_neg / n_pos, negative 1."""
    counts = label_counts(df, label) if counts is None else counts
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    return {0: 1.0, 1: (neg / pos) if pos else 1.0}


def weight_column(label: str, weights: dict[int, float]):
    return F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))


def fit_tasks(n: int) -> int:
    return max(1, -(-n // ROWS_A_TASK))


def sized(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` training rows in partitions of about ROWS_A_TASK rows. A fit runs a job a level of every tree over all
    partitions, so on many small ones it spends its time starting tasks."""
    return rows.repartition(fit_tasks(n))


def nullable_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns holding at least one NULL/NaN (one aggregate)."""
    if not cols:
        return []
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")))
                   .alias(f"n{k}") for k, c in enumerate(cols)]).first()
    return [c for k, c in enumerate(cols) if row[f"n{k}"] > 0]


def preprocess_stages(features: list[str], nullable: list[str], relative_error: float = 0.001):
    """ML3: ``<c>_isna`` indicators + median imputation of the nullable columns
    (Spark trees do not route missing values). Returns (stages, model inputs)."""
    stages, inputs = [], []
    if nullable:
        ind = ", ".join(f"CAST((`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE))) AS DOUBLE) AS `{c}_isna`"
                        for c in nullable)
        stages.append(SQLTransformer(statement=f"SELECT *, {ind} FROM __THIS__"))
        stages.append(Imputer(strategy="median", relativeError=relative_error,
                              inputCols=nullable, outputCols=[f"{c}_imp" for c in nullable]))
    for c in features:
        inputs.append(f"{c}_imp" if c in nullable else c)
    inputs += [f"{c}_isna" for c in nullable]
    return stages, inputs


def side_stages(features: list[str], nullable: list[str]):
    """ML3: each nullable column enters twice, missing as below all values (``_low``) and as above
    all (``_high``). A split on the first sends missing rows left, one on the second right, and the tree takes the
    better one: every split learns its side. Nothing is fitted, no value is made up.
    Returns (stages, model inputs)."""
    stages = []
    if nullable:
        both = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {v!r}D) AS `{c}{side}`"
                         for c in nullable for v, side in zip((BELOW, ABOVE), SIDES))
        stages.append(SQLTransformer(statement=f"SELECT *, {both} FROM __THIS__"))
    inputs = [i for c in features for i in ((f"{c}{SIDES[0]}", f"{c}{SIDES[1]}") if c in nullable else (c,))]
    return stages, inputs


def source_columns(inputs: list[str], features: list[str]) -> list[str]:
    """The source column of every model input; both sides of a column name the same one."""
    own = {f"{c}{side}": c for c in features for side in SIDES}
    return [i if i in set(features) else own[i] for i in inputs]


def gbt_estimator(label: str, weight_col: str | None = None, **params) -> GBTClassifier:
    p = dict(BASE_PARAMS)
    p.update(params)
    est = GBTClassifier(labelCol=label, featuresCol="features", **p)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def input_stages(features: list[str], nullable: list[str], missing: str = "sides", relative_error: float = 0.001) -> list:
    """From the feature columns to the model's vector; ``missing``: "sides" or "impute"."""
    stages, inputs = side_stages(features, nullable) if missing == "sides" else preprocess_stages(features, nullable, relative_error)
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]


def build_pipeline(features: list[str], label: str, nullable: list[str], weight_col: str | None = None,
                   relative_error: float = 0.001, before=(), missing: str = "sides", **params) -> Pipeline:
    """ML1: [own stages,] missing values -> VectorAssembler -> GBTClassifier. ``before``:
    further preprocessing stages, fitted with the pipeline (on the training rows only)."""
    return Pipeline(stages=[*before, *input_stages(features, nullable, missing, relative_error), gbt_estimator(label, weight_col, **params)])


def prepare(df: DataFrame, label: str, weights: dict[int, float] | None) -> DataFrame:
    out = df.withColumn(label, F.col(label).cast("double"))
    if weights is not None:
        out = out.withColumn("weight", weight_column(label, weights))
    return out


def fit(train: DataFrame, features: list[str], label: str, balance: bool = True,
        relative_error: float = 0.001, nullable: list[str] | None = None, before=(), missing: str = "sides",
        **params) -> PipelineModel:
    """``nullable``: the columns with missing values, when already known (e.g. for all
    folds of one table); otherwise found with one aggregate."""
    counts = label_counts(train, label)
    weights = class_weights(train, label, counts) if balance else None
    nullable = nullable_columns(train, features) if nullable is None else nullable
    pipe = build_pipeline(features, label, nullable, "weight" if balance else None, relative_error, before, missing, **params)
    return pipe.fit(sized(prepare(train, label, weights), sum(counts.values())))


def predict(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """ML6: probability of class 1 and the 0.5-cut class."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("proba"),
                      vector_to_array("rawPrediction")[1].alias("margin"),
                      F.col("prediction").cast("int").alias("prediction"))


def evaluate(pred: DataFrame, label: str, beta: float = 10.0, proba: str = "proba",
             predicted: str = "prediction") -> DataFrame:
    """ML7/ML8 on a prediction table: one row of accuracy, precision, recall, f1,
    exact AUC, F-beta."""
    # scored once: both metrics read the checkpointed (label, class, probability) table
    pred = cut_lineage(pred.select(label, predicted, proba))
    counts = M.metrics_from_counts(M.confusion_counts(pred, label, predicted), beta)
    auc = M.roc_auc(pred, label, proba).select("auc")
    return _one_row_join(counts, auc)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    k = F.lit(1).alias("_k")
    return a.select("*", k).join(b.select("*", k), "_k").drop("_k")


def grid_points(grid: dict[str, list]) -> list[dict]:
    """Every combination, the last parameter changing fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble after its first ``n`` iterations. Boosting adds trees one after the other, each seeded by its
    number, so this equals a model fitted with ``maxIter = n``."""
    from pyspark import SparkContext

    sc, own = SparkContext._active_spark_context, model._java_obj
    trees, weights = list(own.trees())[:n], list(own.treeWeights())[:n]
    kinds = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    jtrees, jweights = sc._gateway.new_array(kinds, len(trees)), sc._gateway.new_array(sc._jvm.double, len(weights))
    for i, (t, w) in enumerate(zip(trees, weights)):
        jtrees[i], jweights[i] = t, w
    made = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), jtrees, jweights)
    out = GBTClassificationModel(made)
    out._resetUid(own.uid())
    return out


def staged_counts(model: GBTClassificationModel, data: DataFrame, label: str, iterations: list[int]) -> dict[int, tuple[int, int, int]]:
    """(tp, fp, fn) of the 0.5-cut class after each number of iterations, all in one pass over ``data``."""
    out = data
    for n in iterations:
        part = first_trees(model, n) if n < model.getNumTrees else model
        part = part.copy().setFeaturesCol("features").setPredictionCol(f"_p{n}").setRawPredictionCol(f"_r{n}").setProbabilityCol(f"_q{n}")
        out = part.transform(out).drop(f"_r{n}", f"_q{n}")
    y = F.col(label)
    row = out.agg(*[F.count_if((y == a) & (F.col(f"_p{n}") == p)).alias(f"{name}{n}")
                    for n in iterations for name, a, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))]).first()
    return {n: (row[f"tp{n}"], row[f"fp{n}"], row[f"fn{n}"]) for n in iterations}


def fbeta(tp: int, fp: int, fn: int, beta: float) -> float:
    den = (1 + beta ** 2) * tp + beta ** 2 * fn + fp
    return (1 + beta ** 2) * tp / den if den else 0.0


def grid_search(train: DataFrame, features: list[str], label: str, grid: dict[str, list],
                fold_col: str = "fold", k: int = 5, beta: float = 10.0, parallelism: int | None = None):
    """ML4: every grid point x k stratified folds, scored by F-beta on class 1, best (the first of equal
    ones) refitted on all training rows. Points that differ in ``maxIter`` alone share one fit a fold, at the
    largest: the smaller ones are its first trees, scored in the same pass. The model's input vectors are made
    once for all fits, in as many partitions as the rows need; ``parallelism`` fits run at a time, by default
    as many as the cores hold tasks of. Returns (fitted pipeline, its parameters, results df)."""
    counts = label_counts(train, label)
    weights = class_weights(train, label, counts)
    nullable = nullable_columns(train, features)
    data = prepare(train, label, weights)
    pre = Pipeline(stages=input_stages(features, nullable)).fit(data)  # its stages learn nothing from the rows
    data = pre.transform(data).select(label, "weight", F.col(fold_col).cast("int").alias(fold_col), "features")
    data = sized(data, sum(counts.values())).persist()
    if parallelism is None:
        parallelism = max(4, train.sparkSession.sparkContext.defaultParallelism // fit_tasks(sum(counts.values())))
    points = grid_points(grid)
    shared: dict[str, list[int]] = {}
    for p in points:
        shared.setdefault(json.dumps({n: v for n, v in p.items() if n != "maxIter"}, sort_keys=True), []).append(p.get("maxIter", 20))

    def one(job: tuple[str, int]):
        rest, fold = job
        iterations = sorted(set(shared[rest]))
        est = gbt_estimator(label, "weight", **json.loads(rest), maxIter=iterations[-1])
        model = est.fit(data.where(F.col(fold_col) != fold))
        return rest, staged_counts(model, data.where(F.col(fold_col) == fold), label, iterations)

    scores: dict[tuple[str, int], list[float]] = {}
    try:
        with ThreadPool(parallelism) as pool:
            for rest, found in pool.imap_unordered(one, [(rest, f) for rest in shared for f in range(k)]):
                for n, c in found.items():
                    scores.setdefault((rest, n), []).append(fbeta(*c, beta))
    finally:
        data.unpersist()
    rows = []
    for i, p in enumerate(points):
        each = scores[json.dumps({n: v for n, v in p.items() if n != "maxIter"}, sort_keys=True), p.get("maxIter", 20)]
        rows.append((i, json.dumps(p, sort_keys=True), sum(sorted(each)) / k))
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    res = train.sparkSession.createDataFrame(rows, "grid_index int, params string, mean_fbeta double")
    refit = fit(train, features, label, nullable=nullable, **points[best])
    return refit, points[best], res.withColumn("is_best", F.col("grid_index") == F.lit(best))


def cv_report(df: DataFrame, features: list[str], label: str, fold_col: str = "fold", k: int = 5,
              beta: float = 10.0, before=(), parallelism: int = 4, **params) -> DataFrame:
    """ML5: per-fold fit; train and test metrics; per metric the train mean, test
    mean and gap (from unrounded means), rounded to 3 decimals. ``before``: preprocessing
    stages fitted inside each fold. Up to ``parallelism`` folds run at a time."""
    nullable = nullable_columns(df, features)  # one scan for all folds

    def one(f: int) -> list[DataFrame]:
        tr, te = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        model = fit(tr, features, label, nullable=nullable, before=before, **params)
        return [evaluate(predict(model, part, [label]), label, beta)
                .select(F.lit(f).alias("fold"), F.lit(side).alias("side"), *METRIC_NAMES)
                for side, part in (("train", tr), ("test", te))]

    with ThreadPool(parallelism) as pool:
        parts = [m for fold in pool.map(one, range(k)) for m in fold]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.unpivot(["fold", "side"], METRIC_NAMES, "metric", "value")
    means = long.groupBy("metric").agg(
        F.avg(F.when(F.col("side") == "train", F.col("value"))).alias("tr"),
        F.avg(F.when(F.col("side") == "test", F.col("value"))).alias("te"))
    return means.select("metric", F.round("tr", 3).alias("train_mean"), F.round("te", 3).alias("test_mean"),
                        F.round(F.col("tr") - F.col("te"), 3).alias("gap"))


def gbt_stage(model: PipelineModel):
    return model.stages[-1]


def model_params(model: PipelineModel) -> dict:
    """Everything that ``fit`` needs to train the same way again."""
    g = gbt_stage(model)
    names = ["maxDepth", "maxIter", "stepSize", "minInstancesPerNode", "minWeightFractionPerNode", "minInfoGain", "maxBins",
             "featureSubsetStrategy", "subsamplingRate", "seed"]
    return {n: g.getOrDefault(n) for n in names} | {"balance": g.isDefined("weightCol") and bool(g.getOrDefault("weightCol"))}


def run_record(df_path: str, spark, run_name: str, params: dict, metrics: dict, tag: str = "") -> DataFrame:
    """ML15: publishes one row of a run table (``sources.registry``: safe with several writers, a failed
    attempt leaves nothing) and returns the table."""
    row = spark.createDataFrame(
        [(run_name, json.dumps(params, sort_keys=True, default=str), tag)],
        "run_name string, params string, tag string")
    for k, v in metrics.items():
        row = row.withColumn(k, F.lit(None if v is None else float(v)).cast("double"))
    row = row.withColumn("recorded_at", F.current_timestamp())
    return append_rows(spark, df_path, row)
