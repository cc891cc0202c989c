"""Terms of a dictionary table that occur in texts as substrings.

All terms of a dictionary are looked for in one pass over a text, by a
multi-pattern automaton that each task builds once. The dictionary goes to the
tasks in blocks: its number of rows and bytes are counted first, and terms are
dealt by their hash to as many blocks as keep each near ``BLOCK_BYTES``, so a
dictionary of any size is matched whole and no block grows with it. Texts are
not shuffled and no pairs of texts and terms are formed but the matches.

Defined results: a text is lower-cased before the search, terms are taken as
they are; null and empty terms, and null texts, match nothing; overlapping
occurrences all count, an entry is listed once however often its term occurs;
several entries of one term are all listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docweave.functions.text import normalize_ws

BLOCK_BYTES = 16 << 20
ENTRY_BYTES = 32  # counted for an entry beside its texts
_ENTRY = pa.struct([("ord", pa.int64()), ("term", pa.string()), ("value", pa.string())])
MATCHES = "array<struct<ord: bigint, term: string, value: string>>"


def _search(entries) -> Column:
    """Iterator UDF over one block of entries, held as a broadcast variable."""

    @arrow_udf(MATCHES)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        held = entries.value
        automaton = ahocorasick.Automaton()
        by_term: dict[str, list[int]] = {}
        for i, (_, term, _value) in enumerate(held):
            by_term.setdefault(term, []).append(i)
        for term, at in by_term.items():
            automaton.add_word(term, at)
        automaton.make_automaton()
        names = [f.name for f in _ENTRY]
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                found = {id(at): at for _, at in automaton.iter(text)} if text else {}
                out.append([dict(zip(names, held[i], strict=True)) for at in found.values() for i in at])
            yield pa.array(out, pa.list_(_ENTRY))

    return search


def with_terms(df: DataFrame, dictionary: DataFrame, text_col: str = "text", out_col: str = "terms", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``out_col``: the entries (ord, term, value) of ``dictionary`` whose term occurs in the lower-cased text, sorted.

    ``dictionary`` has the columns ``ord`` (long), ``term`` and ``value``; equal rows count as one entry.
    """
    spark = df.sparkSession
    entries = dictionary.select(F.col("ord").cast("long"), F.col("term").cast("string"), F.col("value").cast("string")).where("length(term) > 0").distinct()
    size = entries.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_BYTES).alias("size")).first()["size"] or 0
    blocks = -(-size // block_bytes)
    found = []
    for block in range(blocks):
        own = entries.where(F.pmod(F.xxhash64("term", "ord", "value"), F.lit(blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast(list(zip(*(own.column(i).to_pylist() for i in range(3)), strict=True)))
        found.append(_search(held)(F.lower(F.col(text_col))))
    matches = F.concat(*found) if found else F.lit(None).cast(MATCHES)
    return df.withColumn(out_col, F.array_sort(F.coalesce(matches, F.array().cast(MATCHES))))


def expand_by_dictionary(df: DataFrame, dictionary: DataFrame, text_col: str = "text", out_col: str = "expanded") -> DataFrame:
    """F8 with the synonyms as a table: the text with collapsed white space, then `` value`` of each entry found, by ``ord``."""
    found = with_terms(df.withColumn(out_col, normalize_ws(text_col)), dictionary, out_col, "__terms")
    extras = F.array_join(F.transform("__terms", lambda e: F.concat(F.lit(" "), F.coalesce(e["value"], F.lit("")))), "")
    return found.withColumn(out_col, F.concat(out_col, extras)).drop("__terms")
