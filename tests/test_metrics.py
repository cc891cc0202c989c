import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from docweave.operators.ordering import trailing_rows_mean, with_global_row_number


def frame(spark, n=997):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 7919) % 5000), float((i * 31) % 17), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double, f int").repartition(6), rows


def test_global_row_number(spark):
    df, rows = frame(spark)
    got = {r.id: r.row_no for r in with_global_row_number(df, ["ts", "id"]).collect()}
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [got[i] for i in order] == list(range(1, len(rows) + 1))


def test_trailing_mean_with_halo(spark):
    df, rows = frame(spark)
    got = {r.id: r.m for r in trailing_rows_mean(df, ["ts", "id"], "v", 10, "m", bucket_rows=37).collect()}
    p = pd.DataFrame(rows, columns=["id", "ts", "v", "f"]).sort_values(["ts", "id"])
    p["m"] = p["v"].rolling(10, min_periods=1).mean()
    assert all(abs(got[r.id] - r.m) < 1e-9 for r in p.itertuples())


def test_running_count(spark):
    from docweave.operators.ordering import running_count

    df, rows = frame(spark)
    got = {r.id: (r.n, r.nf) for r in running_count(df.withColumn("flag", F.col("f") == 1), ["ts", "id"], "flag", "n", "nf").collect()}
    p = pd.DataFrame(rows, columns=["id", "ts", "v", "f"]).sort_values(["ts", "id"])
    p["n"], p["nf"] = range(1, len(p) + 1), p["f"].cumsum()
    want = {r.id: (r.n, r.nf) for r in p.itertuples() if r.f == 1}
    assert got == want


def test_one_second_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from docweave.operators.ordering import running_count, trailing_rows_mean, with_global_row_number

    rows = spark.range(4000).select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.format_string("%05d", F.pmod(F.col("id") * 1237, F.lit(4000))).alias("name"), "id").repartition(5)
    numbered = with_global_row_number(rows, ["ts", "name"])
    assert all(r.row_no == int(r.name) + 1 for r in numbered.collect())
    sizes = [r["count"] for r in numbered.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
    mean = trailing_rows_mean(rows.withColumn("v", F.col("name").cast("double")), ["ts", "name"], "v", 100, "m", bucket_rows=500)
    assert all(abs(r.m - (r.v + max(0, r.v - 99)) / 2) < 1e-9 for r in mean.collect())
    some = running_count(rows.withColumn("bad", F.col("name").cast("int") % 7 == 3), ["ts", "name"], "bad", "total", "failed")
    assert all((r.total, r.failed) == (int(r.name) + 1, int(r.name) // 7 + 1) for r in some.collect()) and some.count() == 571
    assert with_global_row_number(rows.limit(0), ["ts", "name"]).count() == 0
    none = rows.withColumn("ts", F.when(F.col("name") > "00003", F.col("ts")))
    assert {r.name for r in with_global_row_number(none, ["ts", "name"]).where("row_no <= 4").collect()} == {"00000", "00001", "00002", "00003"}
