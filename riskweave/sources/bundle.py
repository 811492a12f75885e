"""Model bundle persistence (SRC7): the fitted pipeline via Spark ML's writer plus a
one-row metadata table (feature names, threshold, target names, params, metrics)."""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskweave.sources.registry import latest, publish

# Class names of the reference's bundle.
TARGET_NAMES = ["Repay_loan", "Not_repay_loan"]


def save_bundle(spark: SparkSession, path: str, model: PipelineModel, features: list[str],
                threshold: float, params: dict, metrics: dict, target_col: str = "TARGET") -> str:
    model.write().overwrite().save(os.path.join(path, "model"))
    meta = spark.createDataFrame([(json.dumps(features), float(threshold), target_col, json.dumps(TARGET_NAMES),
                                   json.dumps(params, sort_keys=True, default=str),
                                   json.dumps(metrics, sort_keys=True))],
                                 "feature_names string, threshold double, target_column string, "
                                 "target_names string, params string, metrics string")
    meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))
    return path


def publish_bundle(spark: SparkSession, root: str, *args, **kwargs) -> tuple[int, str]:
    """``save_bundle`` as the next version of a registry: (number, folder)."""
    return publish(spark, root, lambda path: save_bundle(spark, path, *args, **kwargs))


def load_latest(spark: SparkSession, root: str) -> tuple[PipelineModel, dict]:
    """The bundle published last."""
    return load_bundle(spark, latest(spark, root))


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(os.path.join(path, "model"))
    row = spark.read.parquet(os.path.join(path, "meta")).first()
    meta = {"feature_names": json.loads(row["feature_names"]), "threshold": row["threshold"],
            "target_column": row["target_column"], "target_names": json.loads(row["target_names"]),
            "params": json.loads(row["params"]), "metrics": json.loads(row["metrics"])}
    return model, meta


def gbt_node_table(spark: SparkSession, model_path: str, model: PipelineModel) -> DataFrame:
    """The saved trees as a table: (treeID, nodeData{id, prediction, impurityStats,
    rawCount, leftChild, rightChild, split{featureIndex, leftCategoriesOrThreshold}}).
    The stage folder is ``stages/<index>_<uid>`` (Spark ML's pipeline layout)."""
    idx = len(model.stages) - 1
    return spark.read.parquet(f"{model_path.rstrip('/')}/stages/{idx}_{model.stages[idx].uid}/data")
