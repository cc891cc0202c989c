"""Maximal periodic runs of words in each document, by recompression.

Words become numbers. A run of period q and at least four periods covers three
neighbouring points i of the grid 0, q, 2q, ... with word i = word i + q, so for
every q the grid is compared with itself shifted by one step; all grids together
have n ln n points. For each point with two such neighbours behind it, two longest
common extensions, to the right and to the left of i and i + q, give the run's
exact ends (points of one run give the same ends); they are answered on a
run-length grammar (``grammar``) of the documents that have such points. A stretch found with several periods has the
smallest of them: with four periods of the larger one, the smallest divides it
and has the same ends.

Every task works on slices of its own rows; nothing is shuffled. A text is held
whole by one task, since its result is one row.

Defined results: a null text counts as empty: no words, no runs, an empty
collapsed text; a document without runs keeps all its words; repeated rows each
give a row; a null id stays null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import WORD, id_and_text, sha256_hex, slices
from docweave.llm.grammar import Grammar

PERIODS = 4   # periods that a run covers at least
SHORTEST = 6  # words of a run at least
_SLICE = 4 << 20


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _closed(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences one after another with a symbol of its own before each and at the end, and the places of the sequences."""
    size = np.array([len(p) for p in parts], np.int64)
    at = np.cumsum(size + 1) - size
    out = np.empty(int(size.sum()) + len(parts) + 1, np.int64)
    for p, start in zip(parts, at.tolist(), strict=True):
        out[start : start + len(p)] = p
    out[np.append(at - 1, len(out) - 1)] = least + np.arange(len(parts) + 1)
    return out, at


def _grid(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place, period) of grid points that, as the next PERIODS - 2 points, have the word of one period on.

    ``size`` falls, so the sequences long enough for a period stand at the front.
    """
    found = []
    for q in range(1, int(size[0]) // PERIODS + 1):
        n = int(np.searchsorted(-size, -max(SHORTEST, PERIODS * q), "right"))
        if not n:
            break
        points = words[: int(at[n - 1] + size[n - 1]) : q]
        same = points[1:] == points[:-1]
        place = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        if not len(place):
            continue
        doc = np.searchsorted(at, place, "right") - 1
        inside = (doc >= 0) & (place + (PERIODS - 1) * q < at[doc] + size[doc])
        found.append((doc[inside], place[inside], np.full(int(inside.sum()), q, np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def find_runs(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs as (sequence, start, length, period), by sequence, start and period, in sequences of numbers from 0 on."""
    size = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= SHORTEST]
    none = (np.zeros(0, np.int64),) * 4
    if not len(order):
        return none
    least = 1 + max(int(sequences[i].max()) for i in order)
    words, at = _closed([sequences[i] for i in order], least)
    doc, place, period = _grid(words, at, size[order])
    if not len(doc):
        return none
    used, doc_at = np.unique(doc, return_inverse=True)
    words, there = _closed([sequences[i] for i in order[used]], least)
    place = place - at[doc] + there[doc_at]
    grammar = Grammar(words, words >= least)
    right = grammar.common(place, place + period)
    left = grammar.common(place - 1, place + period - 1, forward=False)
    start, length = place - left - there[doc_at], left + right + period
    long = length >= np.maximum(SHORTEST, PERIODS * period)
    doc, start, length, period = order[doc[long]], start[long], length[long], period[long]
    rank = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[rank], start[rank], length[rank], period[rank]
    first = np.ones(len(doc), bool)
    first[1:] = (np.diff(doc) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    doc, start, length, period = doc[first], start[first], length[first], period[first]
    rank = np.lexsort((period, start, doc))
    return doc[rank], start[rank], length[rank], period[rank]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period) and collapsed, the text with each run cut to its first period."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_SLICE):
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]  # at ASCII white space
            number = _Numbers().__getitem__
            doc, start, length, period = find_runs([np.fromiter(map(number, t), np.int64, len(t)) for t in texts])
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            collapsed = []
            for i, t in enumerate(texts):
                a, b = ends[i], ends[i + 1]
                if a < b:
                    edge = np.zeros(len(t) + 1, np.int64)
                    np.add.at(edge, start[a:b] + period[a:b], 1)
                    np.add.at(edge, start[a:b] + length[a:b], -1)
                    t = compress(t, (np.cumsum(edge[:-1]) == 0).tolist())
                collapsed.append(b" ".join(t))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(run_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                schema=schema,
            )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each document and digests of all its runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha256_hex(F.array_join(lines, "")).alias("runs_sha256"), sha256_hex(F.col("collapsed")).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def with_periodic_tails(df: DataFrame) -> DataFrame:
    """Documents in which, for one id in ten by its CRC-32, the words from some place on repeat from there with a period.

    With h = crc32(decimal id), g = h div 10 and n words: if h mod 10 = 0 and n > 0, words from a = g mod n on
    have the period 1 + (n - a) div (3 + g mod 8). Such a text is its words joined by one space. A null id keeps its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = id_and_text(df).select("doc_id", "text", words.alias("words"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("words").cast("long")
    rows = rows.select("doc_id", "text", "words", "g", n.alias("n"), F.when(n > 0, F.col("g") % n).alias("a"))
    rest = F.col("n") - F.col("a")
    rows = rows.select("doc_id", "text", "words", "n", "a", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p"))
    again = F.flatten(F.array_repeat(tail, F.ceil(rest / F.col("p")).cast("int")))
    made = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), rest.cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
