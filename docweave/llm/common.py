"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import ensure_checkpoint_dir

#: Characters that separate words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handed to Python at once; bounds the memory that long texts take in a task.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators read, under fixed names; other columns are not read."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Memo(dict):
    """A cache with a bounded number of entries, filled by ``make``; emptied when full."""

    def __init__(self, make: Callable, limit: int = 800_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by the running sum of text bytes: at most ``limit`` in a slice, or one longer row alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        end = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = done = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(end, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(end[stop - 1])


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread of that table, not the work before it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)
