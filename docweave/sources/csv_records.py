"""CSV files of any size as records (S5-S7): quotes may span lines, and one file spans tasks.

Whether a line break ends a record depends on the quotes before it in the whole
file. A file is read as lines in byte ranges (the blocks of Spark's text
source), and the parity of quotes is scanned in two passes: the task that reads
a block notes, for either parity before it, which line starts each line's record,
and sums the block up; a prefix over the blocks of a file, a short table, tells
each block the parity and the open record it begins with. A line that starts a
record and has an even number of quotes is a record by itself; only the lines of
longer records are shuffled, by record. Tables with a row per block are stored
before they are joined to lines, so that Spark sees their size.

The header is the first line that holds ``;`` or ``,`` and is no ``Sheet:``
label; lines before it, and their quotes, do not count. Line breaks are ``\\n``,
``\\r\\n`` and ``\\r``; inside quotes they become ``\\n``. A quote opens or closes
wherever it stands in a cell. A file whose quotes do not close falls back to its
lines, so a stray quote never gathers a file in a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import py_strip
from docweave.session import scratch_path
from docweave.sources.files import NA_CELLS, _names, csv_cells

_BLOCK = ["path", "block"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, block, id, line): the lines of every file under ``path``, in the order of (block, id) in a file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line"))
    return lines.withColumn("id", F.monotonically_increasing_id())


def _at() -> Column:
    return F.struct("block", "id")


def _quotes() -> Column:
    return F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))


def scanned(lines: DataFrame) -> DataFrame:
    """The lines with ``quotes``, ``inside`` (the parity of the quotes before a line in its block), ``own0`` and ``own1``.

    ``own0`` and ``own1`` are how far back the last line of the block stands, the line itself included,
    that has this parity before it; -1 where there is none. ``lines`` come as ``read_lines`` reads them: a
    block lies in one task, in order, so nothing is shuffled.
    """
    made = lines.select("path", "block", "id", "line", _quotes().cast("long").alias("quotes"))
    names = ["inside", "own0", "own1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, last = None, 0, [-1, -1]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            path = batch.column(0)
            block, ids, quotes = (batch.column(i).to_numpy() for i in (1, 2, 4))
            file = path.dictionary_encode().indices.to_numpy()
            first = np.ones(n, bool)
            first[1:] = (block[1:] != block[:-1]) | (file[1:] != file[:-1])
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            goes_on = (start == 0) & ((path[0].as_py(), int(block[0])) == at)
            before = np.cumsum(quotes) - quotes
            inside = (before - before[start] + np.where(goes_on, odd, 0)) % 2
            back = []
            for parity in (0, 1):
                place = np.maximum.accumulate(np.where(inside == parity, np.arange(n), -1))
                own = np.where(place >= start, ids[np.maximum(place, 0)], np.where(goes_on, last[parity], -1))
                last[parity] = int(own[-1])
                back.append(np.where(own < 0, -1, ids - own))
            at, odd = (path[n - 1].as_py(), int(block[-1])), int(inside[-1] + quotes[-1]) % 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (inside, *back))], names=[*batch.schema.names, *names])

    return made.mapInArrow(run, "path string, block long, id long, line string, quotes long, " + ", ".join(f"{x} long" for x in names))


def file_facts(lines: DataFrame) -> DataFrame:
    """(path, header, header_inside, sep): where the header stands (null: no such line), the parity before it in its block, and what separates cells."""
    semicolon, comma = F.col("line").contains(";"), F.col("line").contains(",")
    header = (semicolon | comma) & ~py_strip("line").startswith("Sheet:")
    facts = lines.groupBy("path").agg(F.min(F.when(header, F.struct("block", "id", "inside"))).alias("first"), F.max(F.when(semicolon, _at())).alias("last_semicolon"))
    facts = facts.select("path", F.when(F.col("first").isNotNull(), F.struct("first.block", "first.id")).alias("header"), F.col("first.inside").alias("header_inside"), "last_semicolon")
    sep = F.when(F.col("last_semicolon") >= F.coalesce("header", F.col("last_semicolon")), ";").otherwise(",")
    return facts.select("path", "header", "header_inside", sep.alias("sep"))


def from_header(placed: DataFrame) -> DataFrame:
    """Scanned lines from the header on, as if its block began with it."""
    body = placed.where(F.col("header").isNull() | (_at() >= F.col("header")))
    flip = (F.col("block") == F.col("header.block")) & (F.col("header_inside") == 1)
    flip = F.coalesce(flip, F.lit(False))
    inside = F.when(flip, 1 - F.col("inside")).otherwise(F.col("inside"))
    swapped = [F.when(flip, F.col(other)).otherwise(F.col(own)).alias(own) for own, other in (("own0", "own1"), ("own1", "own0"))]
    return body.select("path", "block", "id", "line", "quotes", inside.alias("inside"), *swapped)


def records(lines: DataFrame) -> DataFrame:
    """(path, block, id, text, open): the records of each file of scanned lines, each at the place of its first line.

    ``open`` marks the lines of a file whose quotes do not close; they are not joined.
    """
    starts = [F.max(F.when(F.col("inside") == parity, F.col("id"))).alias(f"last{parity}") for parity in (0, 1)]
    sums = lines.groupBy(*_BLOCK).agg(F.sum("quotes").alias("quotes"), *starts)
    by_file = Window.partitionBy("path").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    blocks = sums.select(
        "path", "block", "last0", "last1", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("parity"), (F.sum("quotes").over(whole) % 2 == 1).alias("open"))
    last = F.when(F.col("parity") == 0, F.col("last0")).otherwise(F.col("last1"))
    blocks = _stored(blocks.select("path", "block", "parity", "open", F.last(last, ignorenulls=True).over(before).alias("carried")), "csv-parities")
    joined = lines.join(blocks, _BLOCK)
    begins = F.col("open") | (F.col("inside") == F.col("parity"))
    back = F.when(F.col("parity") == 0, F.col("own0")).otherwise(F.col("own1"))
    record = F.when(back >= 0, F.col("id") - back).otherwise(F.col("carried"))
    rows = joined.select("path", "block", "id", "line", "open", begins.alias("begins"), (F.col("open") | (F.col("quotes") % 2 == 0)).alias("even"), record.alias("record"))
    alone = rows.where("begins AND even").select("path", "block", "id", F.col("line").alias("text"), "open")
    parts = rows.where("NOT (begins AND even)")
    joined_up = parts.groupBy("path", "record").agg(F.min(_at()).alias("at"), F.array_sort(F.collect_list(F.struct("block", "id", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return alone.unionByName(joined_up.select("path", F.col("at.block").alias("block"), F.col("at.id").alias("id"), text.alias("text"), F.lit(False).alias("open")))


def _cells() -> Column:
    return F.when(F.col("sep") == ";", csv_cells(F.col("text"), ";")).otherwise(csv_cells(F.col("text"), ","))


def csv_file_rows(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``path, row_no, line, fallback``: each record as ``col: val`` cells joined by `` | ``, missing cells left out.

    A first record longer than the header makes its leading cells an index, which
    is not shown. A file with a longer record than that, or with quotes that do
    not close, falls back: all its records (or lines) from the file's start, cells
    joined by ``, ``.
    """
    lines = _stored(scanned(read_lines(spark, path, glob)), "csv-lines")
    # a file's facts by block, so that no file is one task's work; stored, so that Spark knows when they are small enough to go to every task
    blocks = _stored(lines.select(*_BLOCK).distinct().join(file_facts(lines), "path"), "csv-blocks")
    found = records(from_header(lines.join(blocks, _BLOCK))).where(py_strip("text") != "")
    found = _stored(found.join(blocks, _BLOCK).select("path", "block", "id", "text", "open", "sep", _cells().alias("cells")), "csv-records")
    place = F.struct("block", "id")
    first = found.groupBy("path").agg(F.min(place).alias("first"))
    is_header = F.col("first") == place
    marked = found.join(_stored(blocks.select(*_BLOCK).join(first, "path"), "csv-firsts"), _BLOCK)
    shape = marked.groupBy("path").agg(
        F.max(F.when(is_header, F.col("cells"))).alias("header_cells"),
        F.min(F.when(~is_header, F.struct("block", "id", F.size("cells").alias("n")))).alias("second"),
        F.max(F.when(~is_header, F.size("cells"))).alias("longest"),
        F.max("open").alias("open"),
    )
    names = _names(F.col("header_cells"))
    index = F.greatest(F.coalesce(F.col("second.n"), F.lit(0)) - F.size("header_cells"), F.lit(0))
    shape = shape.select("path", names.alias("names"), index.alias("index"), (F.col("open") | (F.coalesce("longest", F.lit(0)) > F.size("header_cells") + index)).alias("bad"))
    shape = _stored(shape, "csv-shapes")
    by_block = _stored(blocks.select(*_BLOCK).join(shape, "path"), "csv-block-shapes")
    rows = marked.where(~is_header).select("path", "block", "id", "cells").join(by_block, _BLOCK).where(~F.col("bad"))
    cell = lambda i: F.get("cells", i + F.col("index"))
    pairs = F.transform("names", lambda n, i: F.when(~F.coalesce(cell(i), F.lit("")).isin(NA_CELLS), F.concat(n, F.lit(": "), cell(i))))
    good = rows.select("path", "block", "id", F.array_join(pairs, " | ").alias("line"), F.lit(False).alias("fallback"))
    out = good
    if not shape.where("bad").isEmpty():
        again = lines.join(by_block.where("bad").select(*_BLOCK), _BLOCK, "left_semi")
        plain = F.when(F.col("text") == "", F.lit("")).otherwise(F.array_join(csv_cells(F.col("text"), ","), ", "))
        fell = _stored(records(again).select("path", "block", "id", plain.alias("line"), F.lit(True).alias("fallback")), "csv-fallback")
        out = good.unionByName(fell)
    counts = out.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"))
    base = counts.select(*_BLOCK, F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = _stored(base, "csv-bases")
    number = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy("id")) - 1
    return out.withColumn("k", number).join(base, _BLOCK).select("path", (F.col("base") + F.col("k")).alias("row_no"), "line", "fallback")
