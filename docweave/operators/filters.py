"""P1 metadata filter: AND of file type and upload-date bounds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound(value: str, end_of_day: bool):
    """Timestamps for date bounds; a bare ``date_to`` includes that whole day."""
    v = value.strip()
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
        try:
            t = dt.datetime.strptime(v, fmt)
        except ValueError:
            continue
        if fmt == "%Y-%m-%d" and end_of_day:
            return t + dt.timedelta(days=1), True
        return t, False
    raise ValueError(f"unparseable date bound: {value!r}")


def _ntz(t: dt.datetime) -> Column:
    """A wall-clock literal, independent of the session time zone."""
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def filter_condition(filters: dict | None, type_col: str = "type", ts_col: str = "uploaded_at") -> Column | None:
    """Column predicate for ``{file_type, date_from, date_to}``; empty values are ignored."""
    if not filters:
        return None
    conds = []
    if filters.get("file_type"):
        conds.append(F.col(type_col) == F.lit(str(filters["file_type"]).upper()))
    if filters.get("date_from"):
        t, _ = _bound(str(filters["date_from"]), False)
        conds.append(F.col(ts_col) >= _ntz(t))
    if filters.get("date_to"):
        t, exclusive = _bound(str(filters["date_to"]), True)
        conds.append(F.col(ts_col) < _ntz(t) if exclusive else F.col(ts_col) <= _ntz(t))
    return reduce(lambda a, b: a & b, conds) if conds else None


def metadata_filter(df: DataFrame, filters: dict | None, **kw) -> DataFrame:
    """Apply P1; with a Parquet collection partitioned by ``type`` this prunes partitions."""
    cond = filter_condition(filters, **kw)
    return df if cond is None else df.where(cond)
