"""Exploding computed arrays without re-computation.

For ``explode`` / ``posexplode`` Catalyst infers a ``size(array) > 0`` filter
and pushes it below the projection that built the array, inlining the whole
array expression (and any Python UDF feeding it) a second time. The ``_outer``
generators get no inferred filter; the empty rows they add are dropped after
the generator instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_kept(df: DataFrame, keep: list, arr: Column | str, pos: str, val: str) -> DataFrame:
    """``keep`` columns plus ``pos`` / ``val`` for every element of ``arr`` (no row for empty arrays)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    out = df.select(*keep, F.posexplode_outer(a).alias(pos, val))
    return out.where(F.col(pos).isNotNull())


def explode_kept(df: DataFrame, keep: list, arr: Column | str, val: str) -> DataFrame:
    a = F.col(arr) if isinstance(arr, str) else arr
    out = df.select(*keep, F.posexplode_outer(a).alias("__pos", val))
    return out.where(F.col("__pos").isNotNull()).drop("__pos")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin across the cluster's cores when the input comes from fewer files.

    Used before CPU-heavy per-row work (chunking). Only the file listing is
    looked at, nothing runs; inputs of many files and streams are left alone.
    """
    if df.isStreaming:
        return df
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= want else df.repartition(want)
