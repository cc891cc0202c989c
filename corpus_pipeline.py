"""A cleaning pipeline over ``documents``: rules, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Each works on all rows its predecessor
kept, and rows of one doc_id are one document; the second stage leaves one row
of those with equal texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import read_table, written
from docweave.llm.jaccard_join import near_duplicates
from docweave.llm.packing import pack_documents
from docweave.llm.quality import keep_good
from docweave.llm.secret_scan import redact_documents
from docweave.llm.substring_dedup import text_keys
from docweave.llm.suffix_dedup import keep_unrepeated

#: Near copies here: shingles of five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with n_chars, where there is one, following a changed text."""
    if "n_chars" in columns:
        kind = df.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.length("text").cast(kind))
    return df.select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each text under one id; under a null id only where no other row has the text.

    Only texts for which that drops a row are dealt out anew, the others are passed through.
    """
    key = ["_id", "_k1", "_k2"]
    k1, k2 = text_keys(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), k1.alias("_k1"), k2.alias("_k2"))
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    texts = counted.groupBy("_k1", "_k2").agg(F.max("n").alias("most"), F.count("_id").alias("ids"), F.count(F.lit(1)).alias("all"))
    again = written(texts.where("most > 1 OR ids BETWEEN 1 AND all - 1").select("_k1", "_k2", (F.col("ids") > 0).alias("_named")), "repeated-rows")
    if again.isEmpty():
        return docs
    once = rows.join(again, ["_k1", "_k2"], "left_anti")
    first = rows.join(again, ["_k1", "_k2"]).where("_id IS NOT NULL OR NOT _named").groupBy(*key).agg(F.min("_row").alias("_row"))
    return once.select("_row.*").unionByName(first.select("_row.*"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once; of those without an id, one row of each other text."""
    near = near_duplicates(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    go = near.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return one_row_each(docs).join(go, "doc_id", "left_anti").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that stand in two places are taken out of both, by whole characters."""
    return _with_text(keep_unrepeated(docs), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return _with_text(redact_documents(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: Suffix sorting, guess costs and the tokenizer have no SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
