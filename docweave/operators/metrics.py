"""Request-log analytics (J3, A3-A7, W5-W8, T3/T4 batch forms).

Input is a table of requests ``request_id, endpoint, ts, success, error,
status_code, duration_ms`` (one row per finished request) or of start/end marks
``request_id, mark, endpoint, ts, success``. Every statistic is a grouped
aggregate with map-side partial aggregation; global orders use
``operators.ordering`` instead of a single-partition window.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import config as C
from docweave.operators.ordering import running_count, trailing_rows_mean


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row as scalar subqueries.

    Each column becomes ``one_row.select(c).scalar()``: Spark runs the subquery
    once and uses its value as a constant - no join, nothing broadcast per row.
    """
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def request_totals(req: DataFrame) -> DataFrame:
    """A3: total / success / failed, mean latency (0 with no requests), last request time."""
    return req.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("success"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.max("ts").alias("last_request_ts"),
    )


def endpoint_stats(req: DataFrame) -> DataFrame:
    """A4: per endpoint count, errors, total and mean time (ms)."""
    return req.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(~F.col("success")).alias("errors"),
        F.sum("duration_ms").alias("total_time"),
        F.avg("duration_ms").alias("avg_time"),
    )


def paired_requests(marks: DataFrame) -> DataFrame:
    """Start and end marks matched by request id; duration from the marks' times."""
    s = marks.where(F.col("mark") == "start").select("request_id", "endpoint", F.col("ts").alias("start_ts"), F.col("event_type").alias("start_type"))
    e = marks.where(F.col("mark") == "end").select("request_id", F.col("ts").alias("end_ts"), "success")
    j = s.join(e, "request_id")
    dur = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / 1000.0
    return j.select("request_id", "endpoint", "start_type", "start_ts", "end_ts", "success", dur.alias("duration_ms"))


def active_requests(marks: DataFrame) -> DataFrame:
    """Starts without an end (anti join)."""
    s = marks.where(F.col("mark") == "start")
    e = marks.where(F.col("mark") == "end").select("request_id")
    return s.join(e, "request_id", "left_anti").select("request_id", "endpoint", F.col("ts").alias("start_ts"))


def orphan_ends(marks: DataFrame) -> DataFrame:
    """Ends without a start - the reference logs a warning for each."""
    e = marks.where(F.col("mark") == "end")
    s = marks.where(F.col("mark") == "start").select("request_id")
    return e.join(s, "request_id", "left_anti").select("request_id", F.col("ts").alias("end_ts"))


def stale_requests(marks: DataFrame, max_age_seconds: int = C.STALE_REQUEST_SECONDS) -> DataFrame:
    """T3 batch: active requests older than ``max_age_seconds`` at "now" = the latest mark."""
    now = marks.agg(F.max("ts").alias("now"))  # one row
    a = attach_scalars(active_requests(marks), now)
    age = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("now")) / 1e6
    return a.select("request_id", "endpoint", "start_ts", age.alias("age_seconds")).where(F.col("age_seconds") > max_age_seconds)


def budget_ms(endpoint) -> F.Column:
    """W7 budget: endpoint-specific for expected long operations, else the slow-request threshold."""
    expr = F.lit(C.SLOW_REQUEST_MS)
    for ep, ms in reversed(C.ENDPOINT_BUDGETS_MS):
        expr = F.when(endpoint == ep, F.lit(ms)).otherwise(expr)
    return expr


def slow_requests(req: DataFrame) -> DataFrame:
    """Requests over their budget."""
    r = req.select("request_id", "endpoint", "ts", "duration_ms", budget_ms(F.col("endpoint")).alias("budget_ms"))
    return r.where(F.col("duration_ms") > F.col("budget_ms"))


def recent_errors(req: DataFrame, shown: int = C.RECENT_ERRORS_SHOWN) -> DataFrame:
    """The latest failures (a top-k report: ``TakeOrderedAndProject``)."""
    f = req.where(~F.col("success")).select("request_id", "endpoint", "error", "ts", "duration_ms")
    return f.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(shown)


def running_error_rate(req: DataFrame, threshold: float = C.ERROR_RATE_THRESHOLD) -> DataFrame:
    """At each failure, failed / total so far in time order, and the alert flag."""
    r = req.select("request_id", "endpoint", "ts", (~F.col("success")).alias("__failed"))
    f = running_count(r, ["ts", "request_id"], "__failed", "total_so_far", "failed_so_far")
    rate = F.col("failed_so_far") / F.greatest(F.col("total_so_far"), F.lit(1))
    return f.select("request_id", "endpoint", "ts", "total_so_far", "failed_so_far", rate.alias("error_rate"), (rate > threshold).alias("alert"))


def health_summary(req: DataFrame, marks: DataFrame, threshold: float = C.ERROR_RATE_THRESHOLD) -> DataFrame:
    """A5: one row - status, issues, error rate, active requests, uptime."""
    t = req.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("success")).alias("failed"),
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("uptime_seconds"),
    )
    act = active_requests(marks).agg(F.count(F.lit(1)).alias("active_requests"))
    j = attach_scalars(t, act)
    rate = F.when(F.col("total") > 0, F.col("failed") / F.col("total"))
    issues = F.array_compact(F.array(
        F.when(rate > threshold, F.format_string(C.ISSUE_HIGH_ERROR_RATE, rate * 100)),
        F.when(F.col("active_requests") > C.ACTIVE_REQUESTS_ALERT, F.format_string(C.ISSUE_MANY_ACTIVE, F.col("active_requests"))),
        F.when(F.col("uptime_seconds") < C.RESTART_UPTIME_SECONDS, F.lit(C.ISSUE_RESTART)),
    ))
    return j.select(
        F.when(F.size(issues) > 0, F.lit(C.STATUS_DEGRADED)).otherwise(F.lit(C.STATUS_HEALTHY)).alias("status"),
        F.array_join(issues, "; ").alias("issues"),
        F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("error_rate"),
        "active_requests", "total", "failed", F.round("uptime_seconds", 3).alias("uptime_seconds"),
    )


def component_status(stats: DataFrame, threshold: float = C.ERROR_RATE_THRESHOLD) -> DataFrame:
    """Per-component status and the overall roll-up (degraded if any error / unavailable)."""
    comp = stats.select(
        F.col("endpoint").alias("component"),
        F.when(F.col("count") == F.col("errors"), F.lit("unavailable"))
        .when(F.col("errors") / F.col("count") > threshold, F.lit("error"))
        .otherwise(F.lit("ok")).alias("status"),
    )
    overall = comp.agg(F.when(F.bool_or(F.col("status").isin("error", "unavailable")), F.lit(C.STATUS_DEGRADED)).otherwise(F.lit("ok")).alias("status"))
    return comp.unionByName(overall.select(F.lit("overall").alias("component"), "status"))


def middleware_metrics(req: DataFrame, samples: DataFrame) -> DataFrame:
    """Success rate % (HTTP 200-399), mean response time, peak memory."""
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 400)
    r = req.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~ok).alias("failed_requests"),
        F.avg("duration_ms").alias("avg_response_time_ms"),
    )
    m = samples.agg(F.max("rss_mb").alias("peak_memory_mb"))
    j = attach_scalars(r, m)
    rate = (F.col("total_requests") - F.col("failed_requests")) / F.greatest(F.col("total_requests"), F.lit(1)) * 100
    return j.select("total_requests", "failed_requests", F.round(rate, 6).alias("success_rate"),
                    F.round("avg_response_time_ms", 3).alias("avg_response_time_ms"), F.round("peak_memory_mb", 3).alias("peak_memory_mb"))


def memory_levels(samples: DataFrame, window: int = C.MEMORY_SAMPLES_KEPT) -> DataFrame:
    """Level per sample (critical first, then warning) and the mean of the last ``window`` samples."""
    lvl = (F.when(F.col("rss_mb") > C.MEMORY_CRITICAL_MB, F.lit("critical"))
           .when(F.col("rss_mb") > C.MEMORY_WARNING_MB, F.lit("warning")).otherwise(F.lit("ok")))
    m = trailing_rows_mean(samples, ["ts", "sample_id"], "rss_mb", window, "rss_mean_window")
    return m.select("sample_id", "ts", "rss_mb", lvl.alias("level"), "rss_mean_window")
