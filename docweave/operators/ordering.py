"""Global order without a window over all rows, by a two-pass prefix sum over range partitions.

First pass: rows are dealt to ranges of the order columns, whose bounds Spark
samples, sorted there and written once with their place in the range. Second
pass: counts of each range, a table as long as the number of ranges, are summed
up in order, and each range's offset is added to its rows. Equal times are parted
by the other order columns, so a log whose events share one second is spread
like any other; no range depends on how dense the times are.

The order must be total.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import scratch_path


def _numbered(df: DataFrame, order_cols: list, flag: str | None) -> DataFrame:
    """``df`` with ``__row`` and, for a flag column, ``__flagged``: running counts in the global order, inclusive."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flagged = F.coalesce(F.col(flag), F.lit(False)).cast("long") if flag else F.lit(0).cast("long")
    placed = df.repartitionByRange(ranges, *order_cols).sortWithinPartitions(*order_cols)
    placed = placed.withColumn("__id", F.monotonically_increasing_id()).withColumn("__f", flagged)
    path = scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("__range", F.shiftright("__id", 33))  # the task that wrote a row, and its place there
    offsets, n, f = [], 0, 0
    for r in sorted(rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("f")).collect()):  # one row a range
        offsets.append((r["__range"], n, f))
        n, f = n + r.n, f + r.f
    known = F.broadcast(spark.createDataFrame(offsets, "__range long, __n long, __before long"))
    rows = rows.join(known, "__range").withColumn("__row", F.col("__n") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1)
    if flag:
        inside = Window.partitionBy("__range").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("__flagged", F.col("__before") + F.sum("__f").over(inside))
    return rows.drop("__range", "__n", "__before", "__id", "__f")


def with_global_row_number(df: DataFrame, order_cols: list, out: str = "row_no") -> DataFrame:
    """Add a 1-based global row number in ``order_cols`` order; rows without a time come first."""
    return _numbered(df, order_cols, None).withColumnRenamed("__row", out)


def trailing_rows_mean(df: DataFrame, order_cols: list, value: str, n_rows: int, out: str, bucket_rows: int = 100_000) -> DataFrame:
    """Mean of ``value`` over the last ``n_rows`` rows (current included) in a global order.

    Rows are cut into parts of fixed size by global row number; each part also
    receives the last ``n_rows - 1`` rows of the part before it, so a window
    by part sees all it needs and no part is larger than another.
    """
    numbered = with_global_row_number(df, order_cols, "__rn")
    part = F.floor((F.col("__rn") - 1) / bucket_rows)
    own = F.struct(part.alias("part"), F.lit(False).alias("halo"))
    next_ = F.when((F.col("__rn") - 1) % bucket_rows >= bucket_rows - (n_rows - 1), F.struct((part + 1).alias("part"), F.lit(True).alias("halo")))
    both = numbered.withColumn("__at", F.explode(F.filter(F.array(own, next_), lambda x: x.isNotNull())))
    w = Window.partitionBy("__at.part").orderBy("__rn").rowsBetween(-(n_rows - 1), Window.currentRow)
    return both.withColumn(out, F.avg(value).over(w)).where(~F.col("__at.halo")).drop("__at", "__rn")


def running_count(df: DataFrame, order_cols: list, flag: str, total_out: str, flag_out: str) -> DataFrame:
    """Rows where ``flag`` is true, with the number of rows and of flagged rows up to and including each."""
    n = _numbered(df, order_cols, flag)
    return n.where(F.col(flag)).withColumnRenamed("__row", total_out).withColumnRenamed("__flagged", flag_out)
