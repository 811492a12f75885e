"""The streaming scorer resumes from its checkpoint: a restart processes only new
request files (no duplicates in the append-mode sink)."""

import os
import tempfile

from pyspark.sql import functions as F

from riskweave.operators.clean import with_position
from riskweave.streaming.score_stream import run_available_now, scoring_stream


def test_restart_processes_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="rw-stream-")
    req_dir, sink, ckpt = (os.path.join(base, x) for x in ("req", "sink", "ckpt"))
    clients = with_position(spark.range(1, 21).select(F.col("id").alias("k"), (F.col("id") / 20.0).alias("p")), "k")
    cdir = os.path.join(base, "clients")
    clients.write.parquet(cdir)
    clients = spark.read.parquet(cdir)
    schema = "request_no BIGINT, raw STRING"

    def add(batch, ids):
        spark.createDataFrame([(batch * 100 + i, str(r)) for i, r in enumerate(ids)], schema) \
            .coalesce(1).write.mode("append").parquet(req_dir)

    def run():
        s = scoring_stream(spark, req_dir, schema, "raw", clients, 20,
                           lambda df: df.withColumn("proba", F.col("p")), 0.3)
        run_available_now(s.select("request_no", "client_id", "proba", "Class"), sink, ckpt)
        return spark.read.parquet(sink)

    add(1, [1, 5, 0, "x", 20])
    first = run()
    assert sorted(r.request_no for r in first.collect()) == [100, 101, 104]
    add(2, [7, 25, 7])
    second = run()
    got = sorted(r.request_no for r in second.collect())
    assert got == [100, 101, 104, 200, 202]  # no duplicates after the restart
    assert {r.request_no: r.Class for r in second.collect()}[104] == "default"  # p = 1.0 > 0.3
