"""Registered queries: request-log analytics (J3, A3-A7, W5-W8, T3/T4 batch, F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import config as C
from docweave.operators import metrics as M
from docweave.sources.tables import request_log, request_marks, table

TS = "yyyy-MM-dd HH:mm:ss"


def _fmt(c):
    return F.date_format(c, TS)


def samples_view(spark, sf):
    """Memory samples: one per event, rss = value x 100 MB (so both thresholds fire)."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("sample_id"), "ts", (F.col("value") * 100.0).alias("rss_mb"))


def request_totals(spark, sf):
    t = M.request_totals(request_log(spark, sf))
    return t.select("total", "success", "failed", "avg_latency_ms", _fmt("last_request_ts").alias("last_request_ts"))


def endpoint_stats(spark, sf):
    s = M.endpoint_stats(request_log(spark, sf))
    return s.select("endpoint", "count", "errors", F.round("total_time", 3).alias("total_time"), F.round("avg_time", 3).alias("avg_time"))


def request_durations(spark, sf):
    p = M.paired_requests(request_marks(spark, sf))
    p = p.withColumn("endpoint", F.when(F.col("start_type") == "purchase", F.concat(F.lit("LONG_OP "), "endpoint")).otherwise(F.col("endpoint")))
    s = M.endpoint_stats(p)
    return s.select("endpoint", "count", "errors", F.round("total_time", 3).alias("total_time"), F.round("avg_time", 3).alias("avg_time"))


def active_requests(spark, sf):
    a = M.active_requests(request_marks(spark, sf))
    return a.select("request_id", "endpoint", _fmt("start_ts").alias("start_ts"))


def stale_requests(spark, sf):
    s = M.stale_requests(request_marks(spark, sf))
    return s.select("request_id", "endpoint", F.round("age_seconds", 3).alias("age_seconds"))


def slow_requests(spark, sf):
    s = M.slow_requests(request_log(spark, sf))
    return s.select("request_id", "endpoint", F.round("duration_ms", 3).alias("duration_ms"), "budget_ms")


def recent_errors(spark, sf):
    r = M.recent_errors(request_log(spark, sf))
    return r.select("request_id", "endpoint", "error", _fmt("ts").alias("ts"), F.round("duration_ms", 3).alias("duration_ms"))


def running_error_rate(spark, sf):
    r = M.running_error_rate(request_log(spark, sf))
    return r.select("request_id", "endpoint", F.col("total_so_far").cast("bigint"), F.col("failed_so_far").cast("bigint"),
                    F.round("error_rate", 6).alias("error_rate"), "alert")


def health_summary(spark, sf):
    return M.health_summary(request_log(spark, sf), request_marks(spark, sf))


def component_status(spark, sf):
    return M.component_status(M.endpoint_stats(request_log(spark, sf)))


def middleware_metrics(spark, sf):
    return M.middleware_metrics(request_log(spark, sf), samples_view(spark, sf))


def metric_window(spark, sf):
    m = M.memory_levels(samples_view(spark, sf))
    return m.select("sample_id", F.round("rss_mb", 3).alias("rss_mb"), "level", F.round("rss_mean_window", 6).alias("rss_mean_window"))


def orphan_ends(spark, sf):
    """Ends of requests whose start was never tracked."""
    return M.orphan_ends(request_marks(spark, sf)).select("request_id", F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_ts"))


QUERIES = {
    "orphan_ends": orphan_ends,
    "request_totals": request_totals,
    "endpoint_stats": endpoint_stats,
    "request_durations": request_durations,
    "active_requests": active_requests,
    "stale_requests": stale_requests,
    "slow_requests": slow_requests,
    "recent_errors": recent_errors,
    "running_error_rate": running_error_rate,
    "health_summary": health_summary,
    "component_status": component_status,
    "middleware_metrics": middleware_metrics,
    "metric_window": metric_window,
}

REQ_CTE = """
    ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
    req AS (
      SELECT event_id AS request_id, ['/upload', '/search', '/documents', '/optimize', '/reset'][(k % 5) + 1] AS endpoint, ts,
             event_type <> 'error' AS success,
             CASE WHEN event_type = 'error' THEN 'request failed k=' || CAST(k AS VARCHAR) END AS error,
             CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 400 WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
             value * 1000.0 AS duration_ms
      FROM ev),
    marks AS (
      SELECT event_id // 2 AS request_id, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 'refused' WHEN event_id % 2 = 0 THEN 'start'
                  WHEN event_type = 'view' THEN 'progress' ELSE 'end' END AS mark,
             ['/upload', '/search', '/documents', '/optimize', '/reset'][(k % 5) + 1] AS endpoint, ts,
             event_type <> 'error' AS success, event_type
      FROM ev),
    starts AS (SELECT * FROM marks WHERE mark = 'start'),
    ends AS (SELECT * FROM marks WHERE mark = 'end'),
    active AS (SELECT s.* FROM starts s ANTI JOIN ends e ON s.request_id = e.request_id)"""

W = "WITH " + REQ_CTE
F_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
_STATS = ("SELECT endpoint, count(*) AS count, CAST(count_if(NOT success) AS BIGINT) AS errors, round(sum(duration_ms), 3) AS total_time, "
          "round(avg(duration_ms), 3) AS avg_time FROM {src} GROUP BY endpoint")
_BUDGET = "CASE WHEN endpoint = '/upload' THEN 120000.0 WHEN endpoint = '/admin/upload_vectors' THEN 300000.0 ELSE 10000.0 END"

ORACLE = {
    "orphan_ends": W + f"""
    SELECT request_id, {F_TS.format(c='ts')} AS end_ts FROM ends e ANTI JOIN starts s ON s.request_id = e.request_id""",
    "request_totals": W + f"""
        SELECT count(*) AS total, CAST(count_if(success) AS BIGINT) AS success, CAST(count_if(NOT success) AS BIGINT) AS failed,
               round(coalesce(avg(duration_ms), 0.0), 2) AS avg_latency_ms, {F_TS.format(c='max(ts)')} AS last_request_ts FROM req""",
    "endpoint_stats": W + "\n" + _STATS.format(src="req"),
    "request_durations": W + """,
    paired AS (
      SELECT CASE WHEN s.event_type = 'purchase' THEN 'LONG_OP ' || s.endpoint ELSE s.endpoint END AS endpoint, e.success,
             (epoch_us(e.ts) - epoch_us(s.ts)) / 1000.0 AS duration_ms
      FROM starts s JOIN ends e ON s.request_id = e.request_id)
    """ + _STATS.format(src="paired"),
    "active_requests": W + f"\n    SELECT request_id, endpoint, {F_TS.format(c='ts')} AS start_ts FROM active",
    "stale_requests": W + f"""
    SELECT request_id, endpoint, round((epoch_us((SELECT max(ts) FROM marks)) - epoch_us(ts)) / 1e6, 3) AS age_seconds
    FROM active WHERE (epoch_us((SELECT max(ts) FROM marks)) - epoch_us(ts)) / 1e6 > {C.STALE_REQUEST_SECONDS}""",
    "slow_requests": W + f"""
    SELECT request_id, endpoint, round(duration_ms, 3) AS duration_ms, {_BUDGET} AS budget_ms FROM req WHERE duration_ms > {_BUDGET}""",
    "recent_errors": W + f"""
    SELECT request_id, endpoint, error, {F_TS.format(c='ts')} AS ts, round(duration_ms, 3) AS duration_ms
    FROM req WHERE NOT success ORDER BY req.ts DESC, request_id DESC LIMIT {C.RECENT_ERRORS_SHOWN}""",
    "running_error_rate": W + f""",
    r AS (SELECT request_id, endpoint, success,
                 count(*) OVER (ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total_so_far,
                 sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS failed_so_far
          FROM req)
    SELECT request_id, endpoint, CAST(total_so_far AS BIGINT) AS total_so_far, CAST(failed_so_far AS BIGINT) AS failed_so_far,
           round(failed_so_far / greatest(total_so_far, 1), 6) AS error_rate, failed_so_far / greatest(total_so_far, 1) > {C.ERROR_RATE_THRESHOLD} AS alert
    FROM r WHERE NOT success""",
    "health_summary": W + f""",
    t AS (SELECT count(*) AS total, CAST(count_if(NOT success) AS BIGINT) AS failed, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS uptime_seconds FROM req),
    a AS (SELECT count(*) AS active_requests FROM active),
    j AS (SELECT *, CASE WHEN total > 0 THEN failed / total END AS rate FROM t, a),
    iss AS (SELECT *, list_filter([
              CASE WHEN rate > {C.ERROR_RATE_THRESHOLD} THEN printf('High error rate: %.1f%%', rate * 100) END,
              CASE WHEN active_requests > {C.ACTIVE_REQUESTS_ALERT} THEN 'Many active requests: ' || CAST(active_requests AS VARCHAR) END,
              CASE WHEN uptime_seconds < {C.RESTART_UPTIME_SECONDS} THEN 'Recent restart detected' END], lambda x: x IS NOT NULL) AS issues FROM j)
    SELECT CASE WHEN len(issues) > 0 THEN 'degraded' ELSE 'healthy' END AS status, array_to_string(issues, '; ') AS issues,
           round(coalesce(rate, 0.0), 6) AS error_rate, active_requests, total, failed, round(uptime_seconds, 3) AS uptime_seconds FROM iss""",
    "component_status": W + f""",
    s AS (SELECT endpoint, count(*) AS n, CAST(count_if(NOT success) AS BIGINT) AS errors FROM req GROUP BY endpoint),
    c AS (SELECT endpoint AS component, CASE WHEN n = errors THEN 'unavailable' WHEN errors / n > {C.ERROR_RATE_THRESHOLD} THEN 'error' ELSE 'ok' END AS status FROM s)
    SELECT * FROM c UNION ALL
    SELECT 'overall', CASE WHEN bool_or(status IN ('error', 'unavailable')) THEN 'degraded' ELSE 'ok' END FROM c""",
    "middleware_metrics": W + """,
    r AS (SELECT count(*) AS total_requests, CAST(count_if(NOT (status_code >= 200 AND status_code < 400)) AS BIGINT) AS failed_requests, avg(duration_ms) AS art FROM req),
    m AS (SELECT max(value * 100.0) AS peak FROM events)
    SELECT total_requests, failed_requests, round((total_requests - failed_requests) / greatest(total_requests, 1) * 100, 6) AS success_rate,
           round(art, 3) AS avg_response_time_ms, round(peak, 3) AS peak_memory_mb FROM r, m""",
    "metric_window": f"""
    SELECT event_id AS sample_id, round(value * 100.0, 3) AS rss_mb,
           CASE WHEN value * 100.0 > {C.MEMORY_CRITICAL_MB} THEN 'critical' WHEN value * 100.0 > {C.MEMORY_WARNING_MB} THEN 'warning' ELSE 'ok' END AS level,
           round(avg(value * 100.0) OVER (ORDER BY ts, event_id ROWS BETWEEN {C.MEMORY_SAMPLES_KEPT - 1} PRECEDING AND CURRENT ROW), 6) AS rss_mean_window
    FROM events""",
}
