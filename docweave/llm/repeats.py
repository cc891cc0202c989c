"""Rows whose key occurs in two or more units, found in one shuffle that no hot key can fill.

A slice (some thousand texts in a task) already shows which of its keys occur in
two of its units; such rows are sure. Only the first row of a key in a slice goes
to the partition of that key; the other sure rows are spread by place.
So a partition gets at most one row of a key from each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.wordhash import mix


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable sorting order by the keys (first key first), and a mark at the first row of each group in it."""
    order = np.lexsort(keys[::-1])
    first = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        first[1:] = ~same
    return order, first


def route(unit: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a slice: where to send it, and whether its keys occur in another unit of the slice."""
    if not len(unit):
        return unit.astype(np.int64), np.zeros(0, bool)
    order, first = groups(*keys)
    starts = np.flatnonzero(first)
    u = unit[order]
    many = np.minimum.reduceat(u, starts) != np.maximum.reduceat(u, starts)
    group = np.cumsum(first) - 1
    sure = np.empty(len(unit), bool)
    sure[order] = many[group]
    to = keys[0].copy()
    spread = order[many[group] & ~first]
    to[spread] = mix(to[spread] + spread.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return to.view(np.int64), sure


def whole_partition(batches: Iterator[pa.RecordBatch], schema_names: list[str]) -> dict[str, np.ndarray]:
    """The columns of all batches of a partition, as NumPy arrays."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return {}
    t = pa.Table.from_batches(got)
    return {n: t.column(n).to_numpy() for n in schema_names}


def repeated_rows(rows: DataFrame, keys: list[str], units: list[str]) -> DataFrame:
    """Of ``rows`` (with the columns ``to`` and ``sure`` of ``route``), those whose keys occur in two units.

    All columns but ``sure`` are 64-bit integers. Rows that differ in a ``units`` column are of different units.
    """
    names = rows.columns
    kept = [n for n in names if n not in ("to", "sure")]
    schema = pa.schema([(n, pa.int64()) for n in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = whole_partition(batches, names)
        if not c:
            return
        order, first = groups(*(c[k] for k in keys))
        starts = np.flatnonzero(first)
        many = np.logical_or.reduceat(c["sure"][order].astype(bool), starts)
        for u in units:
            v = c[u][order]
            many |= np.minimum.reduceat(v, starts) != np.maximum.reduceat(v, starts)
        chosen = order[many[np.cumsum(first) - 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c[n][chosen]) for n in kept], schema=schema)

    return rows.repartition("to").mapInArrow(run, ", ".join(f"{n} long" for n in kept))
