"""Job events as a stream: the latest state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("completed", "failed", "timeout")


def job_states(events: DataFrame, watermark: str = "1 hour", span: str = "1 day") -> DataFrame:
    """(job_id, status, at, started_at, completed_at) of each job, for batch and streaming input (id, status, ts).

    Running stamps started_at, a final status completed_at, each when it is first met. A stream has a
    row for each job and span of event time, with its column span_start: when the watermark passes the
    span its states are let go, so what is held is bounded by the jobs of a span.
    """
    keys = [F.col("id").alias("job_id")]
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
        keys.append(F.window("ts", span))
    first = lambda *states: F.min(F.when(F.col("status").isin(*states), F.col("ts")))
    out = events.groupBy(*keys).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("at"), first("running").alias("started_at"), first(*FINAL).alias("completed_at"))
    return out.withColumn("span_start", F.col("window.start")).drop("window") if events.isStreaming else out
