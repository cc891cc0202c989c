"""Removal of word runs that an earlier document holds, by anchors at difference-cover positions.

A window is ``window`` words of one text; it is a copy if its words also start
in a document with a smaller id. Runs of ``window - period + 1`` words are hashed
only where the position modulo the period lies in a difference cover: for two
equal windows, wherever they stand, some offset below the period brings both
onto cover positions, so they share an aligned anchor. Windows that hold no
anchor found in two texts are thereby settled; the others are extended to full
windows and matched by a 128-bit hash of their words.

Equal texts are one unit with its smallest id, so a group of copies costs one
text; no key of a hot passage gathers in one task (see ``repeats``). Hashes are
64 bits for anchors, which only select, and 128 bits for windows, which decide.

Defined results: a null text has no words; a text of fewer words than a window
loses nothing; rows with one id and equal texts are equal results; a null id
counts as larger than any other; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import id_and_text, slices
from docweave.llm.repeats import groups, repeated_rows, route, whole_partition
from docweave.llm.wordhash import Words, mix

WINDOW, PERIOD = 50, 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
_NO_ID = (1 << 63) - 1
_SLICE = 2 << 20
_SEED = np.uint64(0xA0761D6478BD642F)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def keyed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, k1, k2): a null text as empty; k1 and k2 name the text."""
    d = id_and_text(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k1, k2 = text_keys(F.col("text"))
    return d.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


def text_keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text, F.length(text))


def _anchors(texts: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(k1, at, to, sure) for every cover position from which a window or its rest may start.

    ``to`` is the anchor's hash, but for sure rows that are spread. Texts are named by k1
    alone here: where two share it, both get the other's places, which only adds candidates.
    """
    names = ["k1", "at", "to", "sure"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    size = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            key = pa.table({"k1": batch.column(1), "k2": batch.column(2)}).to_pandas().drop_duplicates()
            batch = batch.take(pa.array(key.index.to_numpy()))  # copies in a slice count once
            w = Words([t.encode() for t in batch.column(0).to_pylist()])
            if not len(w.hash):
                continue
            n = np.diff(w.first)
            text = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(w.hash)) - w.first[text]
            chosen = np.flatnonzero(in_cover[at % period] & (w.room() >= size) & (n[text] >= window))
            if not len(chosen):
                continue
            anchor, text, at = w.runs(size)[chosen], text[chosen], at[chosen]
            k1 = batch.column(1).to_numpy()[text]
            to, sure = route(k1, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1, at.astype(np.int64), to, sure.astype(np.int64))], schema=schema)

    return texts.select("text", "k1", "k2").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _windows(candidates: DataFrame, window: int, period: int) -> DataFrame:
    """(w2, doc, k1, at, length, to): windows over shared anchors, the earliest of each slice alone.

    A window that a smaller id of its slice also holds is a copy already; runs of those come out
    with ``length`` > 0 and go to any partition. The others have length 0 and go by their hash,
    whose halves are ``to`` and ``w2``. (k1, doc) names the text.
    """
    names = ["w2", "doc", "k1", "at", "length", "to"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            w = Words([t.encode() for t in batch.column(0).to_pylist()])
            n = np.diff(w.first)
            wanted = np.zeros(len(w.hash) + 1, np.int64)
            for i, anchors in enumerate(batch.column(3).to_pylist()):
                at = np.unique(np.array(anchors, np.int64))
                lo, hi = np.maximum(at - period + 1, 0), np.minimum(at, n[i] - window) + 1
                ok = lo < hi
                np.add.at(wanted, w.first[i] + lo[ok], 1)
                np.add.at(wanted, w.first[i] + hi[ok], -1)
            place = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
            if not len(place):
                continue
            w1 = w.runs(window)[place]
            w.hash = mix(w.hash ^ _SEED)
            w2 = w.runs(window)[place]
            text = np.searchsorted(w.first, place, "right") - 1
            at = place - w.first[text]
            k1, doc = (batch.column(j).to_numpy()[text] for j in (1, 2))
            order, first = groups(w1, w2)
            earliest = np.minimum.reduceat(doc[order], np.flatnonzero(first))
            copy = np.empty(len(place), bool)
            copy[order] = doc[order] > earliest[np.cumsum(first) - 1]
            c = np.flatnonzero(copy)
            head = np.ones(len(c), bool)
            head[1:] = (place[c][1:] != place[c][:-1] + 1) | (text[c][1:] != text[c][:-1])
            begin = np.flatnonzero(head)
            length = np.diff(np.append(begin, len(c)))
            runs = c[begin]
            rest = np.flatnonzero(~copy)
            rows = np.concatenate([runs, rest])
            size = np.concatenate([length, np.zeros(len(rest), np.int64)])
            to = np.concatenate([mix(w1[runs] + runs.astype(np.uint64)), w1[rest]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w2[rows].view(np.int64), doc[rows], k1[rows], at[rows].astype(np.int64), size.astype(np.int64), to)], schema=schema)

    return candidates.select("text", "k1", "doc", "anchors").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _copies(windows: DataFrame) -> DataFrame:
    """(k1, doc, at, length): runs of consecutive window starts whose window a smaller id holds."""
    names = windows.columns
    schema = pa.schema([(n, pa.int64()) for n in ("k1", "doc", "at", "length")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = whole_partition(batches, names)
        if not c:
            return
        done = c["length"] > 0
        open_ = np.flatnonzero(~done)
        chosen = np.zeros(len(done), bool)
        if len(open_):
            order, first = groups(c["to"][open_], c["w2"][open_])
            doc = c["doc"][open_][order]
            earliest = np.minimum.reduceat(doc, np.flatnonzero(first))
            chosen[open_[order]] = doc > earliest[np.cumsum(first) - 1]
        rows = np.flatnonzero(done | chosen)
        length = np.maximum(c["length"][rows], 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c["k1"][rows], c["doc"][rows], c["at"][rows], length)], schema=schema)

    return windows.repartition("to").mapInArrow(run, "k1 long, doc long, at long, length long")


def _result(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """For rows (k1, k2, text, doc, starts, lengths): the text without its copies, for the smallest id and for larger ones."""
    fields = [("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            out: list[list] = [[] for _ in fields]
            for text, k1, k2, runs in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                words = text.encode().split()
                kept = words
                if runs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    r = np.array([(x["at"], x["at"] + x["length"] - 1 + window) for x in runs], np.int64)
                    np.add.at(cover, r[:, 0], 1)
                    np.add.at(cover, r[:, 1], -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    kept = [words[i] for i in np.flatnonzero(keep)]
                joined = b" ".join(kept)
                row = (k1, k2, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()) + ((joined.decode(),) if with_text else ())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    ddl = "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return texts.select("text", "k1", "k2", "runs").mapInArrow(run, ddl)


def remove_repeated_runs(df: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and the kept words, joined by spaces)."""
    if not is_cover(cover, period) or period > window:
        raise ValueError("the cover must meet every difference modulo a period no longer than the window")
    texts = keyed_texts(df, id_col, text_col)
    rows = texts.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), "doc_id", "k1", "k2")
    units = rows.groupBy("k1", "k2").agg(F.min("doc").alias("doc"))
    shared = repeated_rows(_anchors(texts, window, period, cover), ["to"], ["k1"])
    anchors = shared.groupBy("k1").agg(F.collect_set("at").alias("anchors"))
    named = units.join(anchors, "k1")
    one_each = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    candidates = one_each.join(named, ["k1", "k2"])
    copies = _copies(_windows(candidates, window, period)).groupBy("k1", "doc").agg(F.collect_list(F.struct("at", "length")).alias("runs"))
    copies = copies.join(units, ["k1", "doc"]).select("k1", "k2", "runs")
    judged = _result(one_each.join(copies, ["k1", "k2"], "left"), window, with_text)
    later = (F.col("doc") > F.col("first_doc")) & (F.col("n_words") >= window)
    empty = F.sha2(F.lit(""), 256)
    out = rows.join(judged.join(units.withColumnRenamed("doc", "first_doc"), ["k1", "k2"]), ["k1", "k2"])
    return out.select(
        "doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(later, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
