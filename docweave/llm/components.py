"""Connected components of links, by rounds of contraction to smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in ``links`` (a, b); component_id is the smallest id reachable.

    Each round ties every id's larger neighbours to its smallest one, then its
    smaller neighbours to the smallest, until nothing changes; the number of
    rounds grows with the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs one round. Links from an id to
    itself make it a component of its own; null ids are left out.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    alone = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        near = _both_ways(edges)
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("a").agg(F.min("b").alias("m"))
    return alone.join(roots.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("m", "id").alias("component_id"))
