"""One stream, two sinks: a failed batch is replaced when it runs again, and clients that are published
while the stream runs are found without a restart."""

import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from riskweave.streaming import serve

SCHEMA = "request_no BIGINT, raw STRING"


def _folders():
    base = tempfile.mkdtemp(prefix="rw-serve-")
    return [os.path.join(base, x) for x in ("requests", "clients", "out", "checkpoint")]


def _add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _clients(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("POSITION"), (F.col("id") * 10).alias("k"), (F.col("id") / 20.0).alias("p"))


def _numbers(spark, out, name):
    return sorted((r.request_no for r in serve.served(spark, out, name).collect()), key=str)


def test_requests_are_answered_once_although_a_batch_fails_in_its_middle(spark, monkeypatch):
    requests, root, out, ckpt = _folders()
    serve.publish_clients(spark, root, _clients(spark, 20))
    _add(spark, requests, [(1, "1"), (2, "0"), (3, "x"), (4, "20"), (5, None), (6, "1"), (None, "7")])
    score = lambda df: df.withColumn("proba", F.col("p"))
    run = lambda: serve.serve_available(spark, requests, SCHEMA, "raw", root, score, 0.3, out, ckpt,
                                        keep=["request_no", "client_id", "k"])
    with monkeypatch.context() as m:  # responses are written, then the job dies before the rejects are
        m.setattr(serve, "rejects", lambda valid: valid.where(F.raise_error(F.lit("executor lost")).isNull()))
        with pytest.raises(StreamingQueryException):
            run()
    assert _numbers(spark, out, serve.RESPONSES) == [1, 4, 6, None]
    run()
    assert _numbers(spark, out, serve.RESPONSES) == [1, 4, 6, None]
    assert _numbers(spark, out, serve.REJECTS) == [2, 3, 5]
    _add(spark, requests, [(8, "2"), (9, "21")])
    run()
    assert _numbers(spark, out, serve.RESPONSES) == [1, 4, 6, 8, None]
    got = {r.request_no: (r.k, r.Class) for r in serve.served(spark, out, serve.RESPONSES).collect()}
    assert got[4] == (200, "default") and got[1] == (10, "no default")
    reasons = {r.request_no: r.status for r in serve.served(spark, out, serve.REJECTS).collect()}
    assert reasons == {2: "not_found", 3: "not_integer", 5: "not_integer", 9: "not_found"}


def test_clients_published_during_the_run_are_found_by_the_next_batch(spark):
    requests, root, out, ckpt = _folders()
    serve.publish_clients(spark, root, _clients(spark, 5))
    for number in (1, 2, 3):
        _add(spark, requests, [(number, "8")])
    calls = []

    def score(df):
        if not calls:
            serve.publish_clients(spark, root, _clients(spark, 9))
        calls.append(1)
        return df.withColumn("proba", F.col("p"))

    serve.serve_available(spark, requests, SCHEMA, "raw", root, score, 0.3, out, ckpt, max_files_per_trigger=1)
    assert len(calls) == 3
    answered = serve.served(spark, out, serve.RESPONSES).collect()
    refused = serve.served(spark, out, serve.REJECTS).collect()
    assert len(answered) == 2 and {r.clients_version for r in answered} == {2} and {r.k for r in answered} == {80}
    assert len(refused) == 1 and refused[0].clients_version == 1 and "between 1 and 5" in refused[0].message


def test_no_requests_and_no_clients(spark):
    requests, root, out, ckpt = _folders()
    _add(spark, requests, [(1, "1")])
    score = lambda df: df.withColumn("proba", F.col("p"))
    with pytest.raises(StreamingQueryException):
        serve.serve_available(spark, requests, SCHEMA, "raw", root, score, 0.3, out, ckpt)
    serve.publish_clients(spark, root, _clients(spark, 0))
    serve.serve_available(spark, requests, SCHEMA, "raw", root, score, 0.3, out, ckpt)
    assert serve.served(spark, out, serve.RESPONSES).count() == 0
    assert [r.status for r in serve.served(spark, out, serve.REJECTS).collect()] == ["not_found"]
