"""Derived views shared by the registered queries (all lazy, all over whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import py_strip
from docweave.functions.vectors import l2_normalize, with_hash_embedding
from docweave.operators.arrays import posexplode_kept
from docweave.operators.chunker import chunk_documents
from docweave.sources.tables import docs_view, table


def point_id(filename, chunk_index, text):
    """Content-derived point id, so re-running an insert is idempotent."""
    return F.sha2(F.concat_ws("#", filename, chunk_index.cast("string"), text), 256)


def chunk_points(spark: SparkSession, sf: str, dim: int = 64) -> DataFrame:
    """Documents -> chunks -> hash-embedded points (the ingest flow)."""
    d = docs_view(spark, sf)
    c = chunk_documents(d, "text", keep=["doc_id", "filename", "type", "uploaded_at"])
    c = c.select(
        point_id(F.col("filename"), F.col("chunk_index"), F.col("chunk_text")).alias("point_id"),
        "doc_id", "filename", "chunk_index", F.col("chunk_text").alias("text"), "uploaded_at", "type",
    )
    return with_hash_embedding(c, "text", "vector", dim)


def question_id(conv, turn):
    """One name for each (conversation, turn)."""
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def question_queries(spark: SparkSession, sf: str, dim: int = 64) -> DataFrame:
    """User turns of the conversations as search queries (raw text, stripped, hash-embedded)."""
    u = table(spark, sf, "conversations").where(F.col("role") == "user")
    q = u.select(question_id("conv_id", "turn").alias("query_id"), py_strip("text").alias("query"))
    return with_hash_embedding(q, "query", "vector", dim)


def embedding_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-computed vectors alone: ``point_id, vector``."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("point_id"), F.col("embedding").alias("vector"))


def embedding_payload(spark: SparkSession, sf: str) -> DataFrame:
    """What belongs to those vectors: the text is that of the document with the same id."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return e.join(d, "vec_id", "left").select(
        F.col("vec_id").cast("string").alias("point_id"),
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("file_"), F.col("label").cast("string"), F.lit(".pdf")).alias("filename"),
        F.lit(0).alias("chunk_index"),
        "text",
    )


def label_centroid_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the unit-length mean of that label's vectors.

    Partial aggregation per (label, dimension) before the shuffle, so a label
    holding most rows still only ships one partial sum per task.
    """
    e = table(spark, sf, "embeddings")
    x = posexplode_kept(e, ["label"], "embedding", "pos", "x")
    m = x.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    c = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("pv"))
    return c.select(F.col("label").cast("bigint").alias("query_id"), l2_normalize(F.transform("pv", lambda s: s["v"])).alias("vector"))
