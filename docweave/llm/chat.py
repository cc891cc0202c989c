r"""Chat logs: events folded into final messages, messages rendered with a loss mask, and read back.

A log row is an event of one message of one conversation. In the order of its
sequence number, ``message``, ``edit`` and ``regenerate`` start the text of the
message anew, ``delta`` adds to it; the last start and what follows it make the
final text. A message is written as ``### role: text</turn>`` and a line end.
Inside texts and roles a backslash becomes ``\b``, ``###`` becomes ``\h``,
``</turn>`` becomes ``\t`` (in roles also ``:`` becomes ``\c``), so the marks only
stand where turns begin and end, and reading back is exact.

Everything is DataFrame expressions. One output row holds one conversation, so
only the turns of a conversation meet in a group, as small rows that are already
escaped. Defined results: a null text or role counts as empty, a null turn comes
first, equal turns are ordered by role and text and all kept, a null conv_id is a
conversation of its own, an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEAD, _TAIL = "### ", "</turn>\n"
_CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]


def escaped(c: Column) -> Column:
    for plain, code in _CODES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(_CODES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each row one whole message."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("conv_id", F.row_number().over(w).cast("long").alias("message"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log (conv_id, message, seq, kind, role, text).

    The role is that of the last event that starts the message anew.
    """
    order = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "text")
    whole = Window.partitionBy("conv_id", "message")
    starts = F.col("kind") != "delta"
    e = events.withColumn("__run", F.count(F.when(starts, 1)).over(order)).withColumn("__last", F.count(F.when(starts, 1)).over(whole))
    e = e.where(F.col("__run") == F.col("__last"))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(starts, 0).otherwise(1).alias("k"), "kind", "text")))
    return e.groupBy("conv_id", "message").agg(
        F.max_by("role", F.struct(starts.alias("s"), "seq")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss holds (start, length) of each assistant text, in code points."""
    role = F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c"))
    m = messages.select("conv_id", "message", "role", F.concat(F.lit(_HEAD), role, F.lit(": ")).alias("head"), escaped(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(_TAIL))
    m = m.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("message", F.concat("head", "body", F.lit(_TAIL)).alias("block"),
                    F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length"))).alias("loss"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return g.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns as (role, text), taken from the formatted text alone."""
    blocks = F.filter(F.split("formatted", "</turn>\n", -1), lambda b: b != "")
    role = lambda b: unescaped(F.replace(F.substring_index(F.substr(b, F.lit(len(_HEAD) + 1)), ": ", 1), F.lit("\\c"), F.lit(":")))
    body = lambda b: unescaped(F.substr(b, F.length(F.substring_index(b, ": ", 1)) + 3))
    under = F.transform("loss", lambda x: F.substr(F.col("formatted"), x["start"] + 1, x["length"]))
    return formatted.select(
        "conv_id", F.transform(blocks, lambda b: F.struct(role(b).alias("role"), body(b).alias("text"))).alias("turns"),
        unescaped(F.array_join(under, "")).alias("loss_text"), "formatted",
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    r = read_back(formatted)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
