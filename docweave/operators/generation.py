"""K3: the text-generation hook over prompt tables.

``generate(prompts, fn)`` takes the ``conv, msg_index, role, content`` table of
``conversation.prompt_messages`` and adds one raw response per conversation.
``fn(messages) -> str`` is a user callable (a remote chat client, a local
model) run in an iterator ``pandas_udf`` so each Python worker sets it up once;
without one, the built-in extractive demo generator (F15, JVM-only) answers
from the context in the system prompt. Responses then go through
``parse_source_marker`` (F11) and ``classify_error`` (F17).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.answers import classify_error, demo_answer

CONTEXT_RE = r"(?s)CONTEXT: (.*)\n\nIf the answer comes from provided documents"


def _bounded_messages(prompts: DataFrame, conv: str) -> DataFrame:
    """Messages per conversation as an ordered array (bounded: system + 12 history + query)."""
    return prompts.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("msg_index", "role", "content"))).alias("messages"))


def generate(prompts: DataFrame, fn: Callable[[list[dict]], str] | Callable[[], Callable[[list[dict]], str]] | None = None,
             conv: str = "conv_id", factory: bool = False) -> DataFrame:
    """``conv, raw_response, error``; a call that raises gives F17's marker or message for its row. With ``factory=True``, ``fn()`` builds the callable once per worker."""
    msgs = _bounded_messages(prompts, conv)
    if fn is None:
        sys_msg = F.filter("messages", lambda m: m["role"] == "system")[0]["content"]
        ctx = F.regexp_extract(sys_msg, CONTEXT_RE, 1)
        ctx = F.when(ctx == "[None]", F.lit("")).otherwise(ctx)
        return msgs.select(conv, demo_answer(ctx)["text"].alias("raw_response"), F.lit(None).cast("string").alias("error"))

    @F.pandas_udf("text string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g = fn() if factory else fn
        for ms in batches:
            rows = []
            for row in ms:
                try:
                    rows.append((g([{"role": m["role"], "content": m["content"]} for m in row]), None))
                except Exception as e:  # noqa: BLE001 - a failed call is that row's answer, as in the service
                    rows.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["text", "error"])

    called = msgs.select(conv, call(F.col("messages")).alias("r"))
    failed = classify_error(F.col("r.error"), F.lit(None).cast("int"))
    return called.select(conv, F.when(F.col("r.error").isNull(), F.col("r.text")).otherwise(failed).alias("raw_response"), F.col("r.error").alias("error"))
