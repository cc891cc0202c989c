"""Prompt assembly over conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions.answers import system_prompt, truncate_context
from docweave.operators.arrays import posexplode_kept


def history_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each user turn paired with the assistant turn right after it (``''`` when there is none).

    An equi-join on ``(conv, turn + 1)`` rather than ``lead()`` over the
    conversation: the join key is unique per turn, so one huge conversation
    is spread over many tasks instead of being sorted in one.
    """
    users = turns.where(F.col(role) == "user").select(conv, F.col(turn).alias("user_turn"), F.col(text).alias("user"))
    nxt = turns.where(F.col(role) == "assistant").select(conv, (F.col(turn) - 1).alias("user_turn"), F.col(text).alias("assistant"))
    j = users.join(nxt, [conv, "user_turn"], "left")
    return j.select(conv, "user_turn", "user", F.coalesce("assistant", F.lit("")).alias("assistant"))


def last_n_pairs(pairs: DataFrame, n: int = C.MAX_CONVERSATION_HISTORY, conv: str = "conv_id", order: str = "user_turn") -> DataFrame:
    """The last ``n`` pairs per conversation (``WindowGroupLimit`` keeps the sort bounded)."""
    w = Window.partitionBy(conv).orderBy(F.col(order).desc())
    return pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def bounded_context(blocks: DataFrame, key: str, order: str, text: str, max_chars: int = C.MAX_CONTEXT_CHARS) -> DataFrame:
    """F12 context per key: blocks joined by a blank line, then truncated.

    Every block adds at least its 2-character separator, so only the first
    ``max_chars // 2 + 1`` blocks of a key can start before the cut: a
    ``row_number`` limit (partial per task, ``WindowGroupLimit``) bounds what is
    sorted and collected per key, however many blocks a key has. The full
    length comes from a separate partial aggregate.
    """
    sep = 2
    head_n = max_chars // sep + 1
    first = blocks.select(key, order, text).withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    first = first.where(F.col("__rn") <= head_n)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = first.select(key, order, text, F.coalesce(F.sum(F.length(text) + sep).over(w), F.lit(0)).alias("__start"))
    kept = b.where(F.col("__start") <= max_chars).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("__kept"))
    total = blocks.groupBy(key).agg((F.sum(F.length(text) + sep) - sep).alias("n_chars"))
    agg = total.join(kept, key, "left")
    joined = F.array_join(F.transform(F.coalesce("__kept", F.array()), lambda s: s[text]), "\n\n")
    # the prefix may end just short of the cut with more blocks to come: add the
    # pending separator, and decide truncation from the full length
    ext = F.when(F.col("n_chars") > F.length(joined), F.concat(joined, F.lit("\n\n"))).otherwise(joined)
    context = F.when(F.col("n_chars") > max_chars, F.concat(F.substring(ext, 1, max_chars), F.lit(C.TRUNCATION_SUFFIX))).otherwise(ext)
    return agg.select(key, context.alias("context"), F.col("n_chars").cast("bigint"),
                      (F.col("n_chars") > max_chars).alias("is_truncated"))


def prompt_messages(final_q: DataFrame, history: DataFrame, contexts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv, msg_index, role, content`` - system, history (non-empty parts), final user query.

    ``final_q``: conv, query; ``history``: conv, user_turn, user, assistant (already
    cut to the last pairs); ``contexts``: conv, context.
    """
    hist = history.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("user_turn", "user", "assistant"))).alias("h"))
    j = final_q.join(hist, conv, "left").join(contexts, conv, "left")
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    hist_msgs = F.flatten(F.transform(F.coalesce("h", F.array().cast(hist.schema["h"].dataType)),
                                      lambda p: F.filter(F.array(msg("user", p["user"]), msg("assistant", p["assistant"])),
                                                         lambda m: F.coalesce(m["content"], F.lit("")) != "")))
    allm = F.concat(F.array(msg("system", system_prompt(truncate_context(F.col("context"))))), hist_msgs, F.array(msg("user", F.col("query"))))
    e = posexplode_kept(j, [conv], allm, "msg_index", "m")
    return e.select(conv, F.col("msg_index").cast("bigint"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))
