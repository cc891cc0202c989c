"""The registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.bin_completion import pack_by_completion
from docweave.llm.bpe_codec import encode_documents
from docweave.llm.chat import conversation_digests, reconstruct, render, turns_as_events
from docweave.llm.collocations import collocations
from docweave.llm.common import read_table
from docweave.llm.jaccard_join import near_duplicates
from docweave.llm.oracles import ORACLE
from docweave.llm.packing import pack_documents
from docweave.llm.periodic_runs import periodic_runs, run_digests, with_periodic_tails
from docweave.llm.quality import quality_report
from docweave.llm.secret_scan import scan_documents, span_digests
from docweave.llm.substring_dedup import remove_repeated_runs
from docweave.llm.suffix_dedup import remove_repeated_bytes
from docweave.llm.token_counts import count_tokens
from docweave.llm.vector_dedup import vector_links


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_runs(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts hold the template's own marks."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return conversation_digests(render(reconstruct(turns_as_events(turns.unionByName(extra)))))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(scan_documents(read_table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(read_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_completion(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_periodic_tails(read_table(spark, sf_dir, "documents"))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_vector_dedup": op2_vector_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_bin_completion": op11_bin_completion,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
