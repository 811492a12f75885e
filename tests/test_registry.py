"""Published versions: several writers, failed attempts, unfinished pointers, run rows, bundles."""

import os
import tempfile
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from riskweave.learn import train as L
from riskweave.sources import registry as R
from riskweave.sources.bundle import load_latest, publish_bundle


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="rw-reg-"), "reg")


def test_writers_at_the_same_time_all_commit(spark):
    root = folder()
    with ThreadPool(6) as pool:
        got = pool.map(lambda i: R.publish(spark, root, lambda path: spark.range(i, i + 1).write.parquet(path)), range(12))
    assert sorted(n for n, _ in got) == list(range(1, 13))
    assert sorted(r["id"] for r in R.read_rows(spark, root).collect()) == list(range(12))
    assert R.latest(spark, root) == dict(got)[12]


def test_one_of_many_writers_gets_a_pointer(spark):
    for k in range(20):
        pointer = os.path.join(folder(), "pointers", f"{k:09d}")
        with ThreadPool(8) as pool:
            got = pool.map(lambda i: R._claimed(spark, pointer, f"{i:032d}"), range(8))
        assert sorted(got) == [False] * 7 + [True]


def test_failed_attempts_leave_nothing_to_see(spark):
    root = folder()
    with pytest.raises(FileNotFoundError):
        R.latest(spark, root)

    def broken(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    R.publish(spark, root, lambda path: spark.range(1).write.parquet(path))
    with pytest.raises(RuntimeError):
        R.publish(spark, root, broken)
    with open(os.path.join(root, "pointers", "000000002"), "w") as f:
        f.write("half a na")  # its writer died
    assert [n for n, _ in R.committed(spark, root)] == [1]
    assert R.publish(spark, root, lambda path: spark.range(5).write.parquet(path))[0] == 3
    assert spark.read.parquet(R.latest(spark, root)).count() == 5


def test_run_rows_of_different_metrics(spark):
    root = folder()
    L.run_record(root, spark, "a", {"x": 1}, {"auc": 0.5})
    runs = L.run_record(root, spark, "b", {"x": 2}, {"auc": None, "f1": 0.25}, tag="t")
    assert [(r["run_name"], r["auc"], r["f1"], r["version"]) for r in runs.orderBy("version").collect()] == [("a", 0.5, None, 1), ("b", None, 0.25, 2)]


def test_bundle_versions(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") > 90).cast("int").alias("y"))
    root = folder()
    for depth in (1, 2):
        model = L.fit(df, ["x"], "y", maxIter=1, maxDepth=depth)
        publish_bundle(spark, root, model, ["x"], 0.1 * depth, L.model_params(model), {"val_auc": 0.5 * depth})
    model, meta = load_latest(spark, root)
    assert meta["params"]["maxDepth"] == 2 and meta["threshold"] == 0.2 and meta["metrics"] == {"val_auc": 1.0}
    assert len(R.committed(spark, root)) == 2
