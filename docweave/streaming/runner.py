"""Run a streaming query to completion into a durable Parquet table.

Sinks are ``foreachBatch`` writers keyed by the micro-batch id, so a batch
replayed after a failure overwrites its own output instead of duplicating it.
A failed query raises; a result is only read once the query has ended. Given a
``location``, checkpoint and output stay there and a later run goes on where
the last one stopped; else each run has a fresh place under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.session import read_parquet_if_there, scratch_path


def places(spark: SparkSession, tag: str, location: str | None = None) -> tuple[str, str]:
    """``(checkpoint, output)`` folders."""
    run = location.rstrip("/") if location else scratch_path(spark, f"stream-{tag}-{uuid.uuid4().hex}")
    return f"{run}/_checkpoint", f"{run}/out"


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _run(stream: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    spark = stream.sparkSession
    before = spark.conf.get(_LISTING_TASKS, None)
    spark.conf.set(_LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))  # else a task for each file of a batch
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()  # raises what ended a failed query
    finally:
        if before is None:
            spark.conf.unset(_LISTING_TASKS)
        else:
            spark.conf.set(_LISTING_TASKS, before)


def run_complete(stream: DataFrame, tag: str, location: str | None = None) -> DataFrame:
    """Complete-mode aggregate: every micro-batch rewrites the whole result table."""
    checkpoint, out = places(stream.sparkSession, tag, location)
    _run(stream, "complete", checkpoint, lambda batch, _epoch: batch.write.mode("overwrite").parquet(out))
    return _stored(stream, out)


def run_append(stream: DataFrame, tag: str, write_batch=None, location: str | None = None) -> DataFrame:
    """Append-mode stream: each micro-batch lands in ``out/batch=<id>`` (overwritten on replay).

    ``write_batch(batch_df, batch_id, out)`` may replace the default writer
    (e.g. to deduplicate against what is already stored).
    """
    checkpoint, out = places(stream.sparkSession, tag, location)

    def write(batch: DataFrame, epoch: int) -> None:
        if write_batch is not None:
            write_batch(batch, epoch, out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _run(stream, "append", checkpoint, write)
    return _stored(stream, out).drop("batch")


def _stored(stream: DataFrame, out: str) -> DataFrame:
    stored = read_parquet_if_there(stream.sparkSession, out)
    return stream.sparkSession.createDataFrame([], stream.schema) if stored is None else stored
