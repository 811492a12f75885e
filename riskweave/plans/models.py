"""The model plan over the labelled documents: model table, split, a trained and
saved bundle with a tuned threshold (memoised per session and data folder, since
several registered queries read the same fitted model)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.learn import train as L
from riskweave.operators import metrics as M
from riskweave.operators.correlate import numeric_columns
from riskweave.operators.explain import leaf_paths, node_rows, split_counts
from riskweave.operators.select import fit_selection
from riskweave.operators.split import stratified_folds, stratified_split
from riskweave.plans import entities as E
from riskweave.session import cut_lineage, scratch_path
from riskweave.sources.bundle import gbt_node_table, load_bundle, publish_bundle

KEY, LABEL = E.KEY, E.LABEL
# Learner settings used by the registered queries (small enough for
# every query to fit in seconds at sf0.01; REFERENCE_GRID holds the full grid).
MODEL_PARAMS = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 5}
QUERY_GRID = {"minWeightFractionPerNode": [0.0005, 0.002], "maxDepth": [3, 5], "maxIter": [5, 10, 20]}
N_BEST = 20
BETA = 10.0


def model_table(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with features and a stratified 60/20/20 split. N_DIGITS is made NULL for German documents so the learner
    meets missing values (made identically wherever it is checked)."""
    lab = E.labelled(E.doc_features(spark, d))
    lab = lab.withColumn("N_DIGITS", F.when(F.col("LANG_de") == 0, F.col("N_DIGITS")))
    lab = lab.withColumn(LABEL, F.col(LABEL).cast("int"))
    return stratified_split(lab, KEY, LABEL, (0.6, 0.2, 0.2), seed=42)


def training_folds(t: Trained) -> DataFrame:
    """The training part with 5 stratified folds."""
    return stratified_folds(t.table.where(F.col("split") == "train"), KEY, LABEL, 5, seed=42)


def feature_list(df: DataFrame) -> list[str]:
    return numeric_columns(df, exclude=[KEY, LABEL])


@dataclass
class Trained:
    table: DataFrame
    features: list[str]
    model: PipelineModel
    path: str
    threshold: float
    model_inputs: list[str]


_CACHE: dict[tuple, Trained] = {}


def forget() -> None:
    """Drops the fitted models and releases the tables they hold."""
    for t in _CACHE.values():
        t.table.unpersist()
    _CACHE.clear()


def trained(spark: SparkSession, d: str) -> Trained:
    """Fit on the train part, tune the F-beta threshold on the validation part,
    save the bundle (memoised per application and data folder)."""
    k = (spark.sparkContext.applicationId, d)
    if k in _CACHE:
        return _CACHE[k]
    table = model_table(spark, d).cache()
    # the selection fitted on the training rows feeds the learner (missing, collinear and top-k cuts)
    spec = fit_selection(table.select(KEY, LABEL, "split", *feature_list(table)), LABEL, KEY,
                         fit_on=F.col("split") == "train")
    feats = [c for c in feature_list(table) if c in spec.keep]
    train = table.where(F.col("split") == "train")
    model = L.fit(train, feats, LABEL, **MODEL_PARAMS)
    val = L.predict(model, table.where(F.col("split") == "val"), [KEY, LABEL])
    val = cut_lineage(val)
    thr = M.best_threshold(M.threshold_sweep(val, LABEL, "proba", BETA)).first()["best_threshold"]
    tuned = L.evaluate(M.apply_threshold(val.drop("prediction"), "proba", thr), LABEL, BETA).first()
    _, path = publish_bundle(spark, scratch_path(spark, "bundles"), model, feats, thr, L.model_params(model), {f"val_{m}": tuned[m] for m in L.METRIC_NAMES})
    inputs = model.stages[-2].getInputCols()
    t = Trained(table, feats, model, path, float(thr), inputs)
    _CACHE[k] = t
    return t


def input_names(t: Trained) -> list[str]:
    """The source column of every model input."""
    return L.source_columns(t.model_inputs, t.features)


def assembled(t: Trained, df: DataFrame, keep: list[str], model: PipelineModel | None = None) -> DataFrame:
    """One transform: model input vector expanded to columns x0..x{p-1}, margin and probability."""
    out = (model or t.model).transform(df)
    xv = vector_to_array("features")
    p = len(t.model_inputs)
    return out.select(*keep, *[xv[k].alias(f"x{k}") for k in range(p)],
                      vector_to_array("rawPrediction")[1].alias("margin"), vector_to_array("probability")[1].alias("proba"))


def paths_of(spark: SparkSession, t: Trained):
    nodes = gbt_node_table(spark, f"{t.path}/model", t.model)
    return leaf_paths(node_rows(nodes), list(t.model.stages[-1].treeWeights)), nodes


def best_features(spark: SparkSession, t: Trained, n: int = N_BEST) -> list[str]:
    """SEL8: top-n source columns by split count (ties by name); splits on either side of a nullable
    column count for the column. Columns never split on count 0 and fill the
    list, as a head(n) over all features does. At most one row per model input reaches the driver."""
    _, nodes = paths_of(spark, t)
    counts = dict.fromkeys(t.features, 0)
    for r in split_counts(nodes, input_names(t)).collect():
        counts[r["feature"]] += r["split_count"]
    return sorted(counts, key=lambda f: (-counts[f], f))[:n]


def bundle_meta(spark: SparkSession, t: Trained) -> dict:
    return load_bundle(spark, t.path)[1]


def params_json(t: Trained) -> str:
    return json.dumps(L.model_params(t.model), sort_keys=True, default=str)
