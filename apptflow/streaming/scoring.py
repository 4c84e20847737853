"""Score arriving requests with the row-local policies.

The reference has no streaming; every row-local operator here (reason text,
priority flag, baseline / averages durations and classes) is a stateless
projection, so the same code runs on a ``readStream`` source. New request
files landing in a directory are scored incrementally; no state, watermark
or shuffle is involved.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apptflow.functions import flags as fx
from apptflow.operators import policies as pol


def score_requests(df: DataFrame) -> DataFrame:
    """Batch or streaming: add reason text, priority and policy durations."""
    d = df.withColumn("reason_text", fx.reason_text())
    d = d.withColumn("is_priority", fx.is_priority("reason_text"))
    d = d.withColumn("baseline_minutes", pol.baseline_minutes("scan_type"))
    return pol.with_averages_policy(d)


def request_stream(spark: SparkSession, source_dir: str, schema) -> DataFrame:
    """A file stream of request rows (parquet files added to ``source_dir``)."""
    return spark.readStream.schema(schema).parquet(source_dir)


def start_scoring(spark: SparkSession, source_dir: str, schema, sink_table: str, checkpoint: str):
    """Start the incremental scoring query into a table sink.

    ``checkpoint`` must be on shared storage so a restarted driver resumes
    exactly once from the same offsets.
    """
    scored = score_requests(request_stream(spark, source_dir, schema)).select(
        "patient_id", "site", "reason_text", "is_priority", "baseline_minutes", "heuristic_minutes",
        "heuristic_class", F.current_timestamp().alias("scored_at"))
    return (scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .toTable(sink_table))
