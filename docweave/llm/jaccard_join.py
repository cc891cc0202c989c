"""Exact Jaccard self-join of documents on word shingles, as a grouped prefix join.

Shingles are put in one global order, rare before frequent; two sets that are
similar enough share a shingle among the first few of both (their prefixes).
Documents with equal sets are one class; classes with equal prefix and size form
one group, which enters the join once. Group pairs that share a prefix shingle
are filtered by size and by place in the order, expanded to their classes,
filtered by a parity signature that bounds the difference of two sets from
below and is longer for larger sets, and the rest verified on the whole sets.

Only components are asked for, so within one very long list of a shingle every
class is first compared with the smallest one; classes that then still lie in
different components are compared with each other, so no link is lost.

The order comes from counts of all documents' shingles in a table of fixed size
(hash buckets); it affects speed alone. Sets are sets of 64-bit hashes.

Defined results: a null or empty text has no shingles and links with nothing;
fewer words than a shingle make one shingle; rows with one id are one node;
a null id is left out of links and keeps a row with a null component; an empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import id_and_text, slices, written
from docweave.llm.components import components
from docweave.llm.repeats import repeated_rows, route
from docweave.llm.wordhash import Words, mix

SHINGLE, PERCENT = 4, 85
SKETCH_BITS = 19
SIGNATURE = 1024  # bits at least; doubled until a set has no more shingles
LONG_LIST = 400
_SLICE = 2 << 20
_PART = 1 << 15  # counters in one row of the table of counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case."""
    w = Words(texts, lower=True)
    runs, out = w.runs(size), []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for h in w.hash[a:b]:
                short = mix(short * np.uint64(0x9E3779B97F4A7C15) + h)
            out.append(short)
        else:
            out.append(runs[:0])
    return out


def _levels(docs: DataFrame, size: int) -> np.ndarray:
    """How far each hash bucket's count stands out: 0 as expected, then by powers of two.

    The driver gets one table of 2 ** SKETCH_BITS counters, whatever the input.
    """
    n_parts = (1 << SKETCH_BITS) // _PART

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, "text", _SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column(0).to_pylist()], size)
            table += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(table))
        parts = table.reshape(n_parts, _PART)
        yield pa.RecordBatch.from_pydict({"part": list(range(n_parts)), "salt": [int(table.sum()) % 64] * n_parts, "counts": [p.tobytes() for p in parts]})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("counts"))
        return pa.table({"part": t.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "part long, salt long, counts binary")
    rows = rows.groupBy("part", "salt").applyInArrow(add, "part long, counts binary")
    rows = rows.groupBy("part").applyInArrow(add, "part long, counts binary")
    table = np.zeros((n_parts, _PART), np.int64)
    for r in rows.collect():
        table[r["part"]] = np.frombuffer(r["counts"], np.int64)
    flat = table.ravel()
    mean = flat.mean()
    above = np.maximum(flat - mean - 4 * np.sqrt(mean), 0)
    return np.where(above > 0, 1 + np.log2(1 + above).astype(np.int64), 0).astype(np.uint8)


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signature(x: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of 2^k classes, as bits; the bits grow with the set, or long sets would all look alike."""
    size = max(SIGNATURE, 1 << (len(x) - 1).bit_length()) if len(x) else SIGNATURE
    bits = np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that two sets do not share, at least, by the bytes of their signatures; a longer one is folded."""
    m = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, m), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _described(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, p1, p2, prefix, signature): set key, prefix key, prefix in order, parity signature."""
    seed = np.uint64(0xA0761D6478BD642F)
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("signature", pa.binary())]
    schema = pa.schema(fields)

    def keys(x: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            a, b = mix(x + seed).sum(dtype=np.uint64), mix(x ^ seed).sum(dtype=np.uint64)
        return int(a.view(np.int64)), int(b.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], size)
            out: list[list] = [[] for _ in fields[1:]]
            for x in sets:
                level = levels[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = np.lexsort((x, level))[: _prefix_size(len(x), percent)] if len(x) else np.zeros(0, np.int64)
                for column, value in zip(out, (len(x), *keys(x), *keys(x[p]), x[p].view(np.int64), signature(x)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, schema.types[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, signature binary")


def _shared(postings: DataFrame) -> DataFrame:
    """Rows (h, g, n, at) of shingles that stand in the prefixes of two groups."""
    names = [*postings.columns, "to", "sure"]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, sure = route(batch.column("g").to_numpy(), batch.column("h").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to), pa.array(sure.astype(np.int64))], schema=schema)

    return repeated_rows(postings.mapInArrow(send, ", ".join(f"{x} long" for x in names)), ["h"], ["g"])


def _could_link(a: str, b: str, percent: int):
    """Size and place: the shared shingle and what follows it must suffice for the overlap asked for."""
    size = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return size & ((100 + percent) * left >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _alike(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule a link out."""
    s = lambda x: signatures.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    p = pairs.join(s("a"), "a").join(s("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (100 - percent) * batch.column(2).to_numpy() // (100 + percent)
            apart = [least_difference(*(np.frombuffer(x.as_buffer(), np.uint8) for x in both)) for both in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=schema).filter(pa.array(np.array(apart, np.int64) <= most))

    return p.select("a", "b", F.col("n_a") + F.col("n_b"), "s_a", "s_b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids that link, by their whole sets; ``docs`` has each class id's text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    set_schema = pa.schema([("doc_id", pa.int64()), ("items", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            sets = shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], schema=set_schema)

    sets = written(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(make, "doc_id long, items binary"), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"items_{x}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for xa, xb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(xa.as_buffer(), np.uint64), np.frombuffer(xb.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(check, "a long, b long")


def near_duplicates(df: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = id_and_text(df, id_col, text_col)
    levels = _levels(docs, size)
    described = written(_described(docs, size, percent, levels), "prefixes")
    real = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("c"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    same = classes.groupBy("p1", "p2", "n").agg(F.min("c").alias("g"), F.count(F.lit(1)).alias("members"))
    classes = written(classes.join(same, ["p1", "p2", "n"]), "classes")
    one = classes.select(F.col("c").alias("doc_id"), "s1", "s2", "n", "g", "c")
    # one row per class: equal rows of the same id are dropped by the set's key
    head = real.join(one, ["doc_id", "s1", "s2", "n"]).dropDuplicates(["doc_id", "s1", "s2", "n"])
    signatures = head.select("c", "n", "signature")
    postings = head.where("c = g").select("g", "n", F.posexplode("prefix").alias("at", "h")).select("h", "g", "n", F.col("at").cast("long").alias("at"))
    shared = _shared(postings)
    spread = shared.join(classes.select("g", "c"), "g").select("h", "c", "n", "at")
    inside = classes.where("members > 1").select(F.xxhash64(F.col("g"), F.lit("group")).alias("h"), "c", "n", F.lit(0).cast("long").alias("at"))
    lists = written(spread.unionByName(inside), "lists")
    counted = lists.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least"))
    lists_k = lists.join(counted, "h")
    short = lists_k.where(F.col("k") <= long_list)
    x, y = short.alias("x"), short.alias("y")
    close = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c")) & _could_link("x", "y", percent))
    pairs = close.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    long_ = lists_k.where(F.col("k") > long_list)
    star = long_.where("c > least").select(F.col("least").alias("a"), F.col("c").alias("b"))
    pairs = written(_alike(pairs.unionByName(star).distinct(), signatures, percent), "pairs")
    texts = docs.where("doc_id IS NOT NULL")
    links = written(_verified(pairs, texts, size, percent), "verified")
    if not long_.isEmpty():
        found = components(links.unionByName(classes.select(F.col("c").alias("a"), F.col("c").alias("b"))))
        open_ = long_.join(found.withColumnRenamed("id", "c"), "c")
        mixed = open_.groupBy("h").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi").select("h")
        open_ = open_.join(mixed, "h")
        x, y = open_.alias("x"), open_.alias("y")
        across = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.component_id") != F.col("y.component_id")) & _could_link("x", "y", percent))
        rest = written(_alike(across.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct(), signatures, percent), "pairs")
        links = links.unionByName(_verified(rest, texts, size, percent))
    to_class = real.join(classes.select("s1", "s2", "n", "c"), ["s1", "s2", "n"]).select(F.col("c").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(to_class))
    return described.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

