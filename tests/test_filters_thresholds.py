import datetime as dt


from docweave.operators import metrics as M
from docweave.operators import search as S
from docweave.operators.filters import metadata_filter


def docs(spark):
    rows = [(i, t, dt.datetime(2024, 1, d, h)) for i, (t, d, h) in enumerate([("PDF", 1, 0), ("PDF", 2, 23), ("TXT", 3, 0), ("PDF", 3, 12)])]
    return spark.createDataFrame(rows, "id int, type string, uploaded_at timestamp_ntz")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_metadata_filter(spark):
    d = docs(spark)
    assert ids(metadata_filter(d, None)) == [0, 1, 2, 3]
    assert ids(metadata_filter(d, {"file_type": "pdf"})) == [0, 1, 3]
    assert ids(metadata_filter(d, {"date_from": "2024-01-02"})) == [1, 2, 3]
    assert ids(metadata_filter(d, {"date_to": "2024-01-02"})) == [0, 1]          # whole day included
    assert ids(metadata_filter(d, {"date_to": "2024-01-02 12:00"})) == [0]
    assert ids(metadata_filter(d, {"file_type": "", "date_from": ""})) == [0, 1, 2, 3]
    assert ids(metadata_filter(d, {"file_type": "PDF", "date_from": "2024-01-02", "date_to": "2024-01-03"})) == [1, 3]


def test_threshold_boundaries(spark):
    h = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.15), (1, 4, 0.1499), (2, 1, 1.0), (2, 2, 0.6), (2, 3, 0.5999)],
                              "query_id int, rank int, score double")
    assert sorted(r.rank for r in S.store_threshold(h).where("query_id = 1").collect()) == [1, 2, 3]
    assert sorted(r.rank for r in S.hit_threshold(h).where("query_id = 1").collect()) == [1]
    assert sorted(r.rank for r in S.relative_confidence(h).where("query_id = 2").collect()) == [1, 2]


def req(spark, rows):
    return spark.createDataFrame(rows, "request_id long, endpoint string, ts timestamp_ntz, success boolean, error string, status_code int, duration_ms double")


def test_request_edge_cases(spark):
    empty = req(spark, [])
    t = M.request_totals(empty).first()
    assert (t.total, t.avg_latency_ms) == (0, 0.0)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "/search", base + dt.timedelta(seconds=i), i != 0, None, 200, 10.0) for i in range(10)]
    h = M.health_summary(req(spark, rows), spark.createDataFrame([], "request_id long, mark string, endpoint string, ts timestamp_ntz, success boolean, event_type string")).first()
    assert h.error_rate == 0.1 and "High error rate" not in h.issues  # exactly 10 % is not "high"
    assert "Recent restart detected" in h.issues
    slow = M.slow_requests(req(spark, [(1, "/upload", base, True, None, 200, 120000.0), (2, "/upload", base, True, None, 200, 120001.0),
                                       (3, "/x", base, True, None, 200, 10001.0)]))
    assert sorted(r.request_id for r in slow.collect()) == [2, 3]


def test_marks_pairing(spark):
    base = dt.datetime(2024, 1, 1)
    marks = spark.createDataFrame([
        (1, "start", "/a", base, True, "click"), (1, "end", "/a", base + dt.timedelta(seconds=5), True, "click"),
        (2, "start", "/a", base, True, "click"),                                   # missing end
        (3, "end", "/a", base, True, "click"),                                     # orphan end
        (4, "start", "/a", base + dt.timedelta(seconds=10800), True, "click"),      # age exactly 10,800 s at "now"
        (5, "end", "/a", base + dt.timedelta(seconds=21600), True, "click"),
    ], "request_id long, mark string, endpoint string, ts timestamp_ntz, success boolean, event_type string")
    assert [r.duration_ms for r in M.paired_requests(marks).collect()] == [5000.0]
    assert sorted(r.request_id for r in M.active_requests(marks).collect()) == [2, 4]
    assert sorted(r.request_id for r in M.orphan_ends(marks).collect()) == [3, 5]
    assert sorted(r.request_id for r in M.stale_requests(marks).collect()) == [2]  # 4 is exactly 10,800 s old: not stale
