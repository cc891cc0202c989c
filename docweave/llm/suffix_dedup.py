"""Removal of repeated byte strings by an anchored radix sort of suffixes.

Only suffixes at anchors are sorted: the anchor of a ``size``-byte string is its
leftmost least k-mer by hash, so equal strings have their anchor at the same
place, and every string has one. Anchors whose k-mer occurs once are settled.
For the others each shard (a slice of texts) sends the text before the anchor
and the text from the anchor on. Shards sort nothing.

Where shards meet, the suffixes of a k-mer are sorted eight bytes at a time, only
inside intervals that are not settled yet; the round in which two neighbours part
gives their common prefix.
The same is done with the texts before the anchors, read backwards. A string
that starts ``d`` bytes before its anchor is repeated exactly when another
suffix lies in its interval of common prefix ``size - d`` and in its interval of
common preceding text ``d``. So decisions rest on bytes, not on hashes.

A k-mer with more than ``hot`` anchors (some 40 MB) is not gathered in one task: its strings
are matched by 128-bit hashes, spread by string. Equal texts are one unit.

Defined results: a null text counts as empty; a text below ``size`` bytes loses
nothing; equal texts of ``size`` bytes or more lose everything (also rows with
the same id); a null id stays null; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, written
from docweave.llm.repeats import groups, repeated_rows, route, whole_partition
from docweave.llm.substring_dedup import keyed_texts, text_keys
from docweave.llm.wordhash import mix, powers

SIZE, KMER, HOT = 200, 32, 100_000
SALTS = 64  # tasks that the places of one k-mer are dealt to when they are marked as hot
_SLICE = 2 << 20
#: Starts worked through at once, whatever a text's length; places in such a part fit below _PLACE.
_PART = 2 << 20
_PLACE = np.uint64((1 << 24) - 1)
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Bytes:
    """Several texts end to end, with prefix sums for hashes of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.end = np.cumsum(np.array([len(t) for t in texts], np.int64))
        self.begin = self.end - np.array([len(t) for t in texts], np.int64)

    def hashes(self, length: int, base: np.uint64 = _B1, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Hash of the ``length`` bytes from each place in [start, stop) at which so many are left."""
        data = self.data[start:] if stop is None else self.data[start : stop + length - 1]
        n = len(data)
        if n < length:
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=total[1:])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        return mix((total[length:] - total[:-length]) * powers(inverse, n)[: n - length + 1])

    def hashes_at(self, place: np.ndarray, length: int, base: np.uint64 = _B1, part: int = _PART) -> np.ndarray:
        """The same at chosen places alone, part by part."""
        out = np.empty(len(place), np.uint64)
        for s in range(0, len(self.data), part):
            inside = np.flatnonzero((place >= s) & (place < s + part))
            if len(inside):
                out[inside] = self.hashes(length, base, s, s + part)[place[inside] - s]
        return out

    def anchors(self, size: int, kmer: int, part: int = _PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(k-mer hash, text, place, least and most bytes from a string's start to its anchor), over all strings.

        Worked through in parts of ``part`` starts, which overlap by what their last strings reach.
        """
        found = [self._anchors_from(s, part, size, kmer) for s in range(0, max(len(self.data), 1), part)]
        h, text, place, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
        # an anchor whose starts lie in several parts stands once for each, one after the other
        first = np.flatnonzero(np.diff(place, prepend=-1))
        if len(first) < len(place):
            lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        return h[first], text[first], place[first], lo, hi

    def _anchors_from(self, begin: int, part: int, size: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``anchors`` of the strings that start in [begin, begin + part)."""
        width = size - kmer + 1
        n = min(len(self.data) - size + 1 - begin, part)
        empty = np.zeros(0, np.int64)
        if n < 1:
            return empty.view(np.uint64), empty, empty, empty, empty
        h = self.hashes(kmer, start=begin, stop=begin + n + width - 1)
        if len(h) > int(_PLACE):
            raise ValueError("a part must be short enough for its places to be packed")
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(key) // width) * width, np.uint64((1 << 64) - 1))
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        text = np.searchsorted(self.end, np.arange(begin, begin + n), "right")
        start = np.flatnonzero(np.arange(begin, begin + n) + size <= self.end[text])
        if not len(start):
            return empty.view(np.uint64), empty, empty, empty, empty
        at, text = least[start], text[start]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        place = at[first]
        return h[place], text[first], place + begin, place - start[last], place - start[first]


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words, from their difference."""
    return sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))


def refine(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows by (key, words), and each row's common prefix with the row before it, in bytes.

    ``words`` holds eight bytes a column. Rows of other keys have common prefix -1,
    equal rows the full length.
    """
    n, columns = words.shape
    order = np.argsort(key, kind="stable")
    common = np.full(n, 8 * columns, np.int64)
    edge = np.ones(n, bool)
    edge[1:] = key[order][1:] != key[order][:-1]
    common[edge] = -1
    for t in range(columns):
        alone = edge & np.append(edge[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        interval = np.cumsum(edge)[open_]
        w = words[order[open_], t]
        o = np.lexsort((w, interval))
        order[open_] = order[open_][o]
        w = w[o]
        part = np.flatnonzero((interval[1:] == interval[:-1]) & (w[1:] != w[:-1])) + 1
        common[open_[part]] = 8 * t + _leading_bytes(w[part] ^ w[part - 1])
        edge[open_[part]] = True
    return order, common


def repeated_offsets(key: np.ndarray, before: np.ndarray, after: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, d): strings starting ``d`` in [lo, hi] bytes before the row's anchor that another row also has."""
    n = len(key)
    by_after, common_after = refine(key, after)
    by_before, common_before = refine(key, before)
    rows, offsets = [], []
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        active = np.flatnonzero((lo <= d) & (hi >= d))
        if len(active) < 2:
            continue
        right[by_after] = np.cumsum(common_after < size - d)
        left[by_before] = np.cumsum(common_before < d)
        pair = right[active] * (n + 1) + left[active]
        o = np.argsort(pair, kind="stable")
        same = pair[o][1:] == pair[o][:-1]
        found = np.zeros(len(o), bool)
        found[1:] |= same
        found[:-1] |= same
        hit = active[o[found]]
        rows.append(hit)
        offsets.append(np.full(len(hit), d, np.int64))
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _as_runs(owner: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """Runs of consecutive starts of one owner, as columns (*owner, at, length)."""
    o = np.lexsort((start, *owner[::-1]))
    owner, start = [c[o] for c in owner], start[o]
    head = np.ones(len(o), bool)
    if len(o) > 1:
        head[1:] = (start[1:] != start[:-1] + 1) | np.logical_or.reduce([c[1:] != c[:-1] for c in owner])
    at = np.flatnonzero(head)
    return [*(c[at] for c in owner), start[at], np.diff(np.append(at, len(o)))]


_RUNS = "k1 long, k2 long, at long, length long"
_RUN_SCHEMA = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "at", "length")])
_REACH = 31           # bits of the least reach in ``reach``; the most stands above them


def _lo_hi(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most bytes from a string's start to its anchor."""
    return reach & ((1 << _REACH) - 1), reach >> _REACH


def _anchor_rows(texts: DataFrame, size: int, kmer: int) -> DataFrame:
    names = ["anchor", "k1", "k2", "at", "reach", "to", "sure"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            key = pa.table({"k1": batch.column(1), "k2": batch.column(2)}).to_pandas().drop_duplicates()
            batch = batch.take(pa.array(key.index.to_numpy()))  # copies in a slice count once
            b = Bytes([t.encode() for t in batch.column(0).to_pylist()])
            h, text, place, lo, hi = b.anchors(size, kmer)
            if not len(h):
                continue
            k1, k2 = batch.column(1).to_numpy()[text], batch.column(2).to_numpy()[text]
            to, sure = route(np.arange(len(h)), h)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), k1, k2, place - b.begin[text], hi << _REACH | lo, to, sure.astype(np.int64))], schema=schema)

    return texts.select("text", "k1", "k2").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _suffixes(candidates: DataFrame, size: int, kmer: int) -> DataFrame:
    """(anchor, k1, k2, at, reach, around): the text before an anchor, backwards, then the text from it on."""
    back, ahead = -(-(size - kmer) // 8) * 8, -(-size // 8) * 8
    names = ["anchor", "k1", "k2", "at", "reach"]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("around", pa.binary(back + ahead))])
    step = np.concatenate([-1 - np.arange(back), np.arange(ahead)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            b = Bytes([t.encode() for t in batch.column(0).to_pylist()])
            anchors = batch.column(3).to_pylist()
            text = np.repeat(np.arange(len(anchors)), [len(a) for a in anchors])
            value = {n: np.array([x[n] for a in anchors for x in a], np.int64) for n in ("anchor", "at", "reach")}
            lo, hi = _lo_hi(value["reach"])
            place = b.begin[text] + value["at"]
            for s in range(0, len(text), 8192):
                t, p = text[s : s + 8192], place[s : s + 8192, None] + step
                least, most = lo[s : s + 8192, None], hi[s : s + 8192, None]
                inside = (p >= b.begin[t][:, None]) & (p < b.end[t][:, None]) & (step >= -most) & (step < size - least)  # what a string can reach
                around = np.where(inside, b.data[np.where(inside, p, 0)], 0).astype(np.uint8)
                raw = pa.Array.from_buffers(pa.binary(back + ahead), len(t), [None, pa.py_buffer(around.tobytes())])
                own = {n: pa.array(v[s : s + 8192]) for n, v in value.items()}
                k1, k2 = pa.array(batch.column(1).to_numpy()[t]), pa.array(batch.column(2).to_numpy()[t])
                yield pa.RecordBatch.from_arrays([own["anchor"], k1, k2, own["at"], own["reach"], raw], schema=schema).cast(pa.schema([*schema][:-1] + [pa.field("around", pa.binary())]))

    return candidates.select("text", "k1", "k2", "anchors").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", around binary")


def _merged(suffixes: DataFrame, size: int, kmer: int) -> DataFrame:
    """Runs of starts of repeated strings, from the suffixes of all shards that share a k-mer."""
    back = -(-(size - kmer) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        c = {n: t.column(n).to_numpy() for n in ("anchor", "k1", "k2", "at", "reach")}
        words = np.frombuffer(b"".join(t.column("around").to_pylist()), ">u8").astype(np.uint64).reshape(t.num_rows, -1)
        row, d = repeated_offsets(c["anchor"], words[:, :back], words[:, back:], *_lo_hi(c["reach"]), size)
        columns = _as_runs([c["k1"][row], c["k2"][row]], c["at"][row] - d)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_RUN_SCHEMA)

    return suffixes.repartition("anchor").mapInArrow(run, _RUNS)


def _hashed(candidates: DataFrame, size: int) -> DataFrame:
    """The same for k-mers with very many anchors: strings matched by hash, wherever they stand."""
    names = ["w1", "w2", "k1", "k2", "at", "to", "sure"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            b = Bytes([t.encode() for t in batch.column(0).to_pylist()])
            start, text = [], []
            for i, anchors in enumerate(batch.column(3).to_pylist()):
                for x in anchors:
                    lo, hi = _lo_hi(x["reach"])
                    own = np.arange(x["at"] - hi, x["at"] - lo + 1) + b.begin[i]
                    start.append(own)
                    text.append(np.full(len(own), i))
            start, text = np.concatenate(start), np.concatenate(text)
            w1, w2 = b.hashes_at(start, size), b.hashes_at(start, size, _B2)
            to, sure = route(np.arange(len(start)), w1, w2)
            k1, k2 = batch.column(1).to_numpy()[text], batch.column(2).to_numpy()[text]
            for s in range(0, len(start), 1 << 16):
                cut = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (w1.view(np.int64), w2.view(np.int64), k1, k2, start - b.begin[text], to, sure.astype(np.int64))], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = whole_partition(batches, ["k1", "k2", "at"])
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _as_runs([c["k1"], c["k2"]], c["at"])], schema=_RUN_SCHEMA)

    rows = candidates.select("text", "k1", "k2", "anchors").mapInArrow(strings, ", ".join(f"{n} long" for n in names))
    return repeated_rows(rows, ["w1", "w2"], ["k1", "k2", "at"]).mapInArrow(join, _RUNS)


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> str:
    """What is kept of UTF-8 bytes if a character that lost a byte goes too."""
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    hurt = np.zeros(int(character[-1]) + 1, bool)
    hurt[character[gone]] = True
    return data[~hurt[character]].tobytes().decode()


def _kept(texts: DataFrame, size: int, with_text: bool) -> DataFrame:
    fields = [("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary()), ("kept_text", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            out: list[list] = [[] for _ in fields]
            for text, k1, k2, rows, runs in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                data, whole = text.encode(), text
                n, removed, spans = len(data), 0, 0
                if rows > 1 and n >= size:
                    data, whole, removed, spans = b"", "", n, 1
                elif runs:
                    cover = np.zeros(n + 1, np.int64)
                    r = np.array([(x["at"], x["at"] + x["length"] - 1 + size) for x in runs], np.int64)
                    np.add.at(cover, r[:, 0], 1)
                    np.add.at(cover, r[:, 1], -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    data = np.frombuffer(data, np.uint8)
                    whole = _whole_characters(data, gone) if with_text else ""
                    data = data[~gone].tobytes()
                row = (k1, k2, n, removed, spans, hashlib.sha256(data).hexdigest()) + ((data, whole) if with_text else ())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    ddl = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_text
    return texts.select("text", "k1", "k2", "rows", "runs").mapInArrow(run, ddl)


def _judged(texts: DataFrame, size: int, kmer: int, hot: int, with_text: bool) -> DataFrame:
    """For each distinct text (k1, k2), what is removed."""
    if not 0 < kmer <= size:
        raise ValueError("a k-mer must fit into a string")
    one_each = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))
    shared = written(repeated_rows(_anchor_rows(texts, size, kmer), ["anchor"], ["k1", "k2", "at"]).distinct(), "anchors")
    many = shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = shared.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(many, ["anchor", "salt"], "left").groupBy("k1", "k2").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.struct("anchor", "at", "reach"))).alias("usual"),
        F.collect_list(F.when(F.col("hot"), F.struct("anchor", "at", "reach"))).alias("hot"),
    )
    candidates = one_each.join(marked, ["k1", "k2"])
    of = lambda c: candidates.where(F.size(c) > 0).withColumnRenamed(c, "anchors")
    runs = _merged(_suffixes(of("usual"), size, kmer), size, kmer)
    if not many.isEmpty():
        runs = runs.unionByName(_hashed(of("hot"), size))
    runs = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "length")).alias("runs"))
    return _kept(one_each.join(runs, ["k1", "k2"], "left"), size, with_text)


def remove_repeated_bytes(df: DataFrame, size: int = SIZE, kmer: int = KMER, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, also as whole characters)."""
    texts = keyed_texts(df, id_col, text_col)
    return texts.select("doc_id", "k1", "k2").join(_judged(texts, size, kmer, hot, with_text), ["k1", "k2"]).drop("k1", "k2")


def keep_unrepeated(df: DataFrame, size: int = SIZE, kmer: int = KMER, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated bytes taken out of its texts, by whole characters; a null text stays null."""
    texts = keyed_texts(df, id_col, text_col)
    others = [c for c in df.columns if c != text_col]
    key = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.struct(*others).alias("_row"), F.col(text_col).isNull().alias("_null"), *(c.alias(n) for c, n in zip(text_keys(key), ("k1", "k2"), strict=True)))
    cut = _judged(texts, size, kmer, hot, True).select("k1", "k2", "kept_text")
    out = rows.join(cut, ["k1", "k2"]).select("_row.*", F.when(~F.col("_null"), F.col("kept_text")).alias(text_col))
    return out.select(df.columns)
