"""Traces from arriving events: late and repeated events are sorted out by event time, closed traces are emitted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.operators.query_log import trace_aggregates, with_final_status
from eoframe.streaming.runtime import needs_rocksdb


def trace_stream(events: DataFrame, delay: str = "10 minutes", quiet: str = "5 minutes") -> DataFrame:
    """Traces of (request_id, at, step, state, status and further fields), as ``assemble_traces`` makes them of the same events.

    An event that arrives again within ``delay`` counts once. A trace is closed when nothing came for ``quiet`` of event time and
    the watermark (``delay`` behind the latest event) has passed that; then its state goes. Events of one request that come later
    than that make a trace of their own, with the time it began (``begun``).
    """
    needs_rocksdb(events.sparkSession)
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(events.columns)
    sessions = once.groupBy(F.session_window("at", quiet).alias("session"), "request_id").agg(*trace_aggregates(events.columns))
    return with_final_status(sessions).withColumn("begun", F.col("session.start")).drop("session")
