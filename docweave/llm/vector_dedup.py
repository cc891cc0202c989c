"""Near-duplicate vectors by counting collisions in many one-dimensional projections.

Two vectors whose cosine reaches the threshold differ, on a random direction, by
a normal amount of known spread. Two directions deal vectors out to cells as wide
as several spreads, so a pair meets in one cell or in neighbouring ones. Within
a cell and its neighbours each further direction is a window centred on the
query: a pair collides if its projections lie within the window. Pairs with
enough collisions are verified by their cosine in double precision; how many are
enough follows from the binomial distribution and the recall asked for.

Equal vectors of one label are one class with a weight. A cell with very many
vectors is cut into blocks, so every pair meets in one bounded task, which gives
back sums for each vector and links to one vector of its local component, never
all pairs.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component, or whose label is null, links with nothing and is its own
component; vectors of different lengths never link; rows with one id count as
separate vectors; a null id links like any other but has no component of its own.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import written
from docweave.llm.components import components

THRESHOLD = 0.98
DIRECTIONS = 24
MISS = 1e-7
BASE_BLOCK, QUERY_BLOCK = 1500, 6000


def collisions_needed(directions: int, inside: float, miss: float) -> int:
    """The largest count that a true pair misses with at most the chance ``miss``."""
    total, k = 0.0, 0
    while k <= directions:
        total += comb(directions, k) * inside**k * (1 - inside) ** (directions - k)
        if total > miss:
            return k
        k += 1
    return directions


@lru_cache(maxsize=8)
def _directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(20_011).standard_normal((dim, n))


def _cells(vectors: DataFrame, width: float, directions: int) -> DataFrame:
    """(c, label, weight, dim, x, y, vector, marks): the cell, the vector in doubles, its other projections."""
    fields = [("c", pa.int64()), ("label", pa.int64()), ("weight", pa.int64()), ("dim", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("vector", pa.binary()), ("marks", pa.binary())]
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            size = np.array([len(v) for v in batch.column(3)])
            for dim in np.unique(size):
                part = batch.filter(pa.array(size == dim))
                v = np.array(part.column(3).to_pylist(), np.float64).reshape(part.num_rows, dim)
                with np.errstate(over="ignore"):
                    scaled = v / np.abs(v).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                p = unit @ _directions(int(dim), 2 + directions)
                cell = np.floor(p[:, :2] / width).astype(np.int64)
                marks = p[:, 2:].astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(len(v), dim, np.int64)), pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], schema=schema)

    return vectors.select("c", "label", "weight", "vector").mapInArrow(run, "c long, label long, weight long, dim long, x long, y long, vector binary, marks binary")


def _linked(threshold: float, half_window: float, needed: int):
    """Links inside one block of a cell: sums of weights and a link to the smallest id of the local component."""
    out = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        c, weight = t.column("c").to_numpy(), t.column("weight").to_numpy()
        query, own = t.column("query").to_numpy().astype(bool), t.column("own").to_numpy().astype(bool)
        q, b = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(q) or not len(b):
            return out.empty_table()
        unit = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(len(c), -1)
        marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.float32).reshape(len(c), -1)
        links: dict[int, int] = {}
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent[parent[i]]
            return i

        for start in range(0, len(q), 512):
            part = q[start : start + 512]
            count = np.zeros((len(part), len(b)), np.uint8)
            for j in range(marks.shape[1]):
                count += np.abs(marks[part, j][:, None] - marks[b, j][None, :]) <= half_window
            i, k = np.nonzero(count >= needed)
            i, k = part[i], b[k]
            once = ~own[i] | (c[i] < c[k])  # both stand in this cell: count the pair once
            i, k = i[once], k[once]
            if not len(i):
                continue
            good = np.einsum("ij,ij->i", unit[i], unit[k]) >= threshold
            i, k = i[good], k[good]
            for ids, w in ((c[i], weight[k]), (c[k], weight[i])):
                u, inverse = np.unique(ids, return_inverse=True)
                for x, total in zip(u.tolist(), np.bincount(inverse, weights=w).astype(np.int64).tolist(), strict=True):
                    links[x] = links.get(x, 0) + total
            for x, y in zip(c[i].tolist(), c[k].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ids = list(links)
        return pa.table({"c": pa.array(ids, pa.int64()), "links": pa.array([links[i] for i in ids], pa.int64()), "root": pa.array([find(i) for i in ids], pa.int64())})

    return run


def vector_links(df: DataFrame, threshold: float = THRESHOLD, directions: int = DIRECTIONS, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", base_block: int = BASE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spread = sqrt(2 - 2 * threshold)  # of the difference of two projections at the threshold
    half_window = 2 * spread
    needed = collisions_needed(directions, erf(2 / sqrt(2)), miss)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = written(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn(
        "c", F.coalesce("least", F.xxhash64("label", "vector"))), "classes")
    cells = written(_cells(classes, 4.5 * spread, directions), "cells")
    near = F.expr("explode(array(struct(0 AS dx, 0 AS dy), struct(0 AS dx, 1 AS dy), struct(1 AS dx, -1 AS dy), struct(1 AS dx, 0 AS dy), struct(1 AS dx, 1 AS dy)))")
    key = ["label", "dim", "x", "y"]
    asks = cells.withColumn("near", near).withColumn("own", ((F.col("near.dx") == 0) & (F.col("near.dy") == 0)).cast("long"))
    asks = asks.withColumn("x", F.col("x") + F.col("near.dx")).withColumn("y", F.col("y") + F.col("near.dy")).drop("near")
    n_base = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / base_block).cast("long").alias("n_base"))
    n_ask = asks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / query_block).cast("long").alias("n_ask"))
    blocks = n_base.join(n_ask, key)
    columns = [*key, "b", "q", "c", "weight", "vector", "marks", "query", "own"]
    base = cells.join(blocks, key).withColumn("b", F.pmod(F.xxhash64("c"), "n_base")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_ask") - 1)))
    base = base.withColumn("query", F.lit(0).cast("long")).withColumn("own", F.lit(0).cast("long")).select(columns)
    asks = asks.join(blocks, key).withColumn("q", F.pmod(F.xxhash64("c"), "n_ask")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_base") - 1)))
    asks = asks.withColumn("query", F.lit(1).cast("long")).select(columns)
    found = written(base.unionByName(asks).groupBy(*key, "b", "q").applyInArrow(_linked(threshold, half_window, needed), "c long, links long, root long"), "links")
    sums = found.groupBy("c").agg(F.sum("links").alias("links"))
    near = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    judged = classes.join(sums, "c", "left").join(near.withColumnRenamed("id", "c"), "c", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "c").alias("component_id"))
    alone = rows.where(~(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False))))
    out = usable.join(judged, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
