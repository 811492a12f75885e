"""Serving from one request stream into two sinks (SC6): every micro-batch is read once, its
responses and its rejects are written by ``foreachBatch`` under the batch's number.

* A batch that is run again after a failure replaces its own folders, so every request is answered once.
* Clients come from a versioned registry (``sources.registry``): a batch looks at the pointer and reads
  the client table again only when another version was published, so new clients are served without a restart.

Defined results: a request that is null or no whole number, or that names no client of the version in force, is
rejected with its reason; repeated requests are answered each; a batch without responses or without
rejects leaves an empty table for its number."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.score import decide, lookup, rejects, validate_requests
from riskweave.sources.registry import committed, publish
from riskweave.streaming.score_stream import request_stream

RESPONSES, REJECTS = "responses", "rejects"


def publish_clients(spark: SparkSession, root: str, clients: DataFrame) -> int:
    """Publishes a client table (with its POSITION column) as the next version: its number."""
    return publish(spark, root, lambda path: clients.write.parquet(path))[0]


class Clients:
    """The client table published last, with its number of clients; read again when the version changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version = spark, root, None

    def current(self) -> tuple[int, DataFrame, int]:
        """(version, clients, number of clients)."""
        versions = committed(self.spark, self.root)
        if not versions:
            raise FileNotFoundError(f"no clients are published in {self.root!r}")
        number, path = versions[-1]
        if number != self.version:
            self.table = self.spark.read.parquet(path)
            self.count, self.version = self.table.count(), number
        return self.version, self.table, self.count


def write_batch(batch: DataFrame, batch_id: int, out_dir: str, raw_col: str, clients: Clients,
                score_fn: Callable[[DataFrame], DataFrame], threshold: float, keep: list[str] | None = None) -> None:
    """Answers one micro-batch: responses and rejects under ``batch=<batch_id>``, replacing an earlier attempt."""
    version, table, n = clients.current()
    valid = validate_requests(batch, raw_col, n).persist()  # one read of the requests for both sinks
    try:
        scored = score_fn(lookup(valid, table))
        cls, dec = decide(F.col("proba"), threshold)
        scored = scored.withColumns({"Class": cls, "Decision": dec, "clients_version": F.lit(version)})
        answers = scored.select(*keep, "Class", "Decision", "clients_version") if keep else scored
        refused = rejects(valid).withColumn("clients_version", F.lit(version))
        for name, rows in ((RESPONSES, answers), (REJECTS, refused)):
            rows.write.mode("overwrite").parquet(os.path.join(out_dir, name, f"batch={batch_id}"))
    finally:
        valid.unpersist()


def serve_available(spark: SparkSession, request_dir: str, request_schema: str, raw_col: str, clients_root: str,
                    score_fn: Callable[[DataFrame], DataFrame], threshold: float, out_dir: str, checkpoint_dir: str,
                    keep: list[str] | None = None, max_files_per_trigger: int = 100) -> None:
    """Answers every request file not answered yet, then stops. ``keep``: columns of a response beside
    Class, Decision and clients_version (default all)."""
    clients = Clients(spark, clients_root)
    query = (request_stream(spark, request_dir, request_schema, max_files_per_trigger).writeStream
             .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out_dir, raw_col, clients, score_fn, threshold, keep))
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    query.awaitTermination()


def served(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """One of the two sinks as a table, with each row's ``batch``."""
    return spark.read.parquet(os.path.join(out_dir, name))
