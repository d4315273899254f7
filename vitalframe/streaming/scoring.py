"""Score requests as they arrive (Structured Streaming).

The per-request endpoint becomes a stateless streaming job: JSON request
files land in a folder, ``readStream`` picks them up with the request
schema, the same batch functions (validation, hypotension gate, serving
features, scoring, advice) run on each micro-batch, and a file sink with a
checkpoint gives exactly-once output that survives executor and driver
restarts. No state store is needed, so the job scales with the input rate
by adding partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitalframe.operators.score import DEFAULT_RISK_MODEL, LinearRiskModel, score_requests
from vitalframe.schema import MALFORMED, REQUEST_FILE_SCHEMA


def request_stream(spark: SparkSession, request_dir: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Arriving requests; a line that does not parse keeps its text in ``malformed``."""
    reader = spark.readStream.schema(REQUEST_FILE_SCHEMA).option("columnNameOfCorruptRecord", MALFORMED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(request_dir)


def start_scoring_stream(spark: SparkSession, request_dir: str, output_dir: str,
                         checkpoint_dir: str, model: LinearRiskModel = DEFAULT_RISK_MODEL,
                         available_now: bool = True,
                         max_files_per_trigger: int | None = None,
                         processing_time: str | None = None) -> StreamingQuery:
    """Start the stream: requests -> responses (parquet, append, checkpointed).

    ``available_now`` processes everything present and stops (batch-like
    backfill, still in micro-batches of ``max_files_per_trigger`` files);
    otherwise a ``processing_time`` trigger keeps it running.
    """
    scored = score_requests(request_stream(spark, request_dir, max_files_per_trigger), model)
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("path", output_dir).option("checkpointLocation", checkpoint_dir))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_to_completion(spark: SparkSession, request_dir: str, output_dir: str,
                      checkpoint_dir: str, model: LinearRiskModel = DEFAULT_RISK_MODEL,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Process every request file present now, then read the sink back."""
    q = start_scoring_stream(spark, request_dir, output_dir, checkpoint_dir, model,
                             available_now=True, max_files_per_trigger=max_files_per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(output_dir)
