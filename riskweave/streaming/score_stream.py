"""Real-time scoring as Structured Streaming: a file-source request stream is
validated, joined to the static client table (stream-static join, no state) and
scored; results go to an append-mode parquet sink with a checkpoint, so a restart
(or a lost executor) resumes from the last committed batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.score import decide, lookup, rejects, validate_requests


def request_stream(spark: SparkSession, request_dir: str, request_schema: str,
                   max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(request_schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(request_dir))


def reject_stream(spark: SparkSession, request_dir: str, request_schema: str, raw_col: str, n_clients: int) -> DataFrame:
    """The side output of ``scoring_stream``: rejected requests with status and message."""
    return rejects(validate_requests(request_stream(spark, request_dir, request_schema), raw_col, n_clients))


def scoring_stream(spark: SparkSession, request_dir: str, request_schema: str, raw_col: str,
                   clients: DataFrame, n_clients: int, score_fn: Callable[[DataFrame], DataFrame],
                   threshold: float, max_files_per_trigger: int = 100) -> DataFrame:
    stream = request_stream(spark, request_dir, request_schema, max_files_per_trigger)
    found = lookup(validate_requests(stream, raw_col, n_clients), clients)
    scored = score_fn(found)
    cls, dec = decide(F.col("proba"), threshold)
    return scored.withColumns({"Class": cls, "Decision": dec})


def run_available_now(df: DataFrame, sink_dir: str, checkpoint_dir: str) -> None:
    """Process everything available, then stop (``trigger(availableNow=True)``)."""
    q = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
