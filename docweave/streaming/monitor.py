"""Live request counters and stale-request detection as streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import config as C
from docweave.operators.metrics import endpoint_stats
from docweave.sources.tables import marks_of, requests_of
from docweave.streaming.runner import run_append, run_complete


def as_instant(ts_ntz) -> F.Column:
    """Wall-clock ``timestamp_ntz`` read as UTC, as a ``TIMESTAMP`` (watermarks need one).

    Built from microseconds since the epoch, so it does not depend on the
    session time zone (a plain cast would, including daylight-saving jumps).
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts_ntz))


def live_endpoint_stats(events_stream: DataFrame) -> DataFrame:
    """Per-endpoint counters, updated every micro-batch (complete mode)."""
    return run_complete(endpoint_stats(requests_of(events_stream)), "endpoint-stats")


def _sides(events_stream: DataFrame, lateness: str) -> tuple[DataFrame, DataFrame]:
    """Starts and ends of requests, each with an event-time watermark ``lateness`` behind."""
    marks = marks_of(events_stream)
    starts = marks.where(F.col("mark") == "start").select(
        F.col("request_id").alias("sid"), "endpoint", as_instant(F.col("ts")).alias("start_ts")).withWatermark("start_ts", lateness)
    ends = marks.where(F.col("mark") == "end").select(
        F.col("request_id").alias("eid"), as_instant(F.col("ts")).alias("end_ts")).withWatermark("end_ts", lateness)
    return starts, ends


def _within(max_age_seconds: int) -> F.Column:
    return (F.col("sid") == F.col("eid")) & (F.col("end_ts") >= F.col("start_ts")) & \
        (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {int(max_age_seconds)} SECONDS"))


def stale_request_stream(events_stream: DataFrame, max_age_seconds: int = C.STALE_REQUEST_SECONDS,
                         lateness: str = C.EVENT_LATENESS) -> DataFrame:
    """Starts with no end within ``max_age_seconds`` - a stream-stream left outer join.

    Both sides carry an event-time watermark, so join state is dropped once a
    start is older than the age limit; the unmatched starts are emitted then.
    """
    starts, ends = _sides(events_stream, lateness)
    j = starts.join(ends, _within(max_age_seconds), "leftOuter")
    return j.where(F.col("eid").isNull()).select(F.col("sid").alias("request_id"), "endpoint", "start_ts")


def stale_requests_to_table(events_stream: DataFrame, location: str | None = None, **kw) -> DataFrame:
    return run_append(stale_request_stream(events_stream, **kw), "stale", location=location)


def request_tracker(events_stream: DataFrame, max_age_seconds: int = C.STALE_REQUEST_SECONDS, lateness: str = C.EVENT_LATENESS) -> DataFrame:
    """T3 with all outcomes: ``request_id, endpoint, status, duration_ms``, from one full outer stream-stream join.

    An end within ``max_age_seconds`` makes the request ``completed``; a start
    without one is ``stale``, an end without one is an ``orphan_end``, both once
    the watermark has passed what could still join them. Rows may arrive in any
    order within ``lateness``.
    """
    starts, ends = _sides(events_stream, lateness)
    j = starts.join(ends, _within(max_age_seconds), "fullOuter")
    status = F.when(F.col("sid").isNull(), "orphan_end").when(F.col("eid").isNull(), "stale").otherwise("completed")
    took = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000.0
    return j.select(F.coalesce("sid", "eid").alias("request_id"), "endpoint", status.alias("status"), took.alias("duration_ms"))


def track_requests_to_table(events_stream: DataFrame, location: str | None = None, **kw) -> DataFrame:
    return run_append(request_tracker(events_stream, **kw), "tracker", location=location)
