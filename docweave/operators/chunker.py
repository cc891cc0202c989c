"""F3 sentence-packing chunker.

Text never leaves the JVM: Spark normalises and splits it into sentences, a
vectorised Arrow UDF receives only the per-sentence word counts and returns
chunk boundaries, and Spark slices and joins the sentences back into chunk
texts before ``posexplode`` numbers them (W9).

Chunk rule on prefix sums P (P[i] = words before sentence i), chunk = [a..e]:
  * e = max(forced, last k with P[k+1] - P[a] <= size); the first chunk's forced
    sentence is 0, later chunks must contain the sentence that closed the previous one;
  * the next chunk starts at max(a, last j with P[e+1] - P[j] >= overlap)
    (the shortest sentence suffix of the emitted chunk holding >= overlap words)
    and is forced to contain e + 1;
  * the last chunk runs to the final sentence.
A single sentence is never cut, so a chunk can exceed ``size`` words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions.text import normalize_ws, split_sentences
from docweave.operators.arrays import posexplode_kept, spread


def chunk_bounds(word_counts, size: int, overlap: int) -> list[int]:
    """Flattened ``[a0, e0, a1, e1, ...]`` sentence bounds for one text."""
    n = len(word_counts)
    if n == 0:
        return []
    prefix = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.asarray(word_counts, dtype=np.int64), out=prefix[1:])
    out: list[int] = []
    a = forced = 0
    while True:
        # last m with prefix[m] <= prefix[a] + size; sentences a..m-1 fit
        m = int(np.searchsorted(prefix, prefix[a] + size, side="right")) - 1
        e = min(max(forced, m - 1), n - 1)
        out += (a, e)
        if e >= n - 1:
            return out
        nxt = e + 1
        j = int(np.searchsorted(prefix, prefix[nxt] - overlap, side="right")) - 1
        a, forced = max(a, j), nxt


@lru_cache(maxsize=None)
def _bounds_udf(size: int, overlap: int):
    @F.pandas_udf("array<int>")
    def bounds(counts: pd.Series) -> pd.Series:
        return pd.Series([chunk_bounds(c, size, overlap) for c in counts])

    return bounds


def chunk_documents(
    df: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    size: int = C.CHUNK_SIZE_WORDS,
    overlap: int = C.CHUNK_OVERLAP_WORDS,
) -> DataFrame:
    """One row per chunk: ``keep`` columns, ``chunk_index`` (0-based), ``chunk_text``; none for a null or blank text.

    Narrow: no shuffle, each document is chunked inside the task that read it.
    Three projections: sentences and word counts (JVM), bounds (Arrow UDF,
    ints only), chunk texts (JVM) - then ``posexplode``.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c != text_col]
    df = spread(df.select(*keep, text_col))
    sents = df.select(*keep, split_sentences(normalize_ws(F.coalesce(F.col(text_col), F.lit("")))).alias("__s"))
    counted = sents.select(*keep, "__s", F.transform("__s", lambda s: F.size(F.split(s, " "))).alias("__w"))
    bounded = counted.select(*keep, "__s", _bounds_udf(size, overlap)(F.col("__w")).alias("__b"))
    b = F.col("__b")
    n = (F.size(b) / 2).cast("int")
    texts = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.array_join(F.slice(F.col("__s"), b[j * 2] + 1, b[j * 2 + 1] - b[j * 2] + 1), " "),
    )
    chunks = bounded.select(*keep, F.when(n > 0, texts).otherwise(F.array().cast("array<string>")).alias("__c"))
    return posexplode_kept(chunks, keep, "__c", "chunk_index", "chunk_text")
