"""Registered queries: contexts, prompts, demo answers, markers, error classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions.answers import classify_error as _classify_error
from docweave.functions.answers import demo_answer as _demo_answer
from docweave.functions.answers import parse_source_marker as _parse
from docweave.functions.answers import user_facing_answer
from docweave.operators import conversation as CV
from docweave.operators import search as S
from docweave.plans.search_queries import _answer_sql
from docweave.functions.text import py_strip
from docweave.functions.vectors import with_hash_embedding
from docweave.plans.views import chunk_points, question_id
from docweave.sources.tables import request_log, table


def truncate_context(spark, sf):
    t = table(spark, sf, "conversations")
    return CV.bounded_context(t, "conv_id", "turn", "text")


def build_prompt(spark, sf):
    """Messages for the last user turn of each conversation: system prompt with the
    retrieved context of that turn, the last 6 earlier (user, assistant) pairs, the query."""
    t = table(spark, sf, "conversations")
    pairs = CV.history_pairs(t)
    last = pairs.groupBy("conv_id").agg(F.max("user_turn").alias("last_turn"))
    final_q = pairs.join(last, "conv_id").where(F.col("user_turn") == F.col("last_turn")).select("conv_id", F.col("user").alias("query"), "last_turn")
    hist = CV.last_n_pairs(pairs.join(last, "conv_id").where(F.col("user_turn") < F.col("last_turn")).drop("last_turn"))
    # retrieval only for each conversation's final question (the one being answered)
    qs = with_hash_embedding(final_q.select(F.col("conv_id").alias("query_id"), py_strip("query").alias("q")), "q", "vector", 64)
    hits = S.search(chunk_points(spark, sf), qs, C.TOP_K)
    ctx = S.build_context(hits).select(F.col("query_id").alias("conv_id"), "context")
    return CV.prompt_messages(final_q.select("conv_id", "query"), hist, ctx)


def demo_answer(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("doc_id", _demo_answer("text").alias("a"))
    return a.select("doc_id", F.col("a.text").alias("answer"), F.col("a.source").cast("string").alias("source"))


def parse_source_marker(spark, sf):
    """F11 over the demo generator's raw answers (documents as contexts) and over the
    assistant turns of the conversations (no marker)."""
    d = table(spark, sf, "documents").select(F.lit("answer").alias("kind"), F.col("doc_id").cast("string").alias("id"), _demo_answer("text")["text"].alias("raw"))
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        F.lit("turn").alias("kind"), question_id("conv_id", "turn").alias("id"), F.col("text").alias("raw"))
    p = d.unionByName(c).select("kind", "id", _parse("raw").alias("p"))
    return p.select("kind", "id", F.col("p.text").alias("text"), F.col("p.source").cast("string").alias("source"))


def classify_error(spark, sf):
    """F17; every third failure names the content filter, every seventh the usage policy."""
    r = request_log(spark, sf).where(~F.col("success"))
    named = F.when(F.pmod("request_id", F.lit(3)) == 0, " Content_Filter hit").when(F.pmod("request_id", F.lit(7)) == 0, " ResponsibleAIPolicyViolation").otherwise("")
    r = r.withColumn("error", F.concat("error", named))
    c = r.select("request_id", "status_code", _classify_error(F.col("error"), F.col("status_code")).alias("cleaned"))
    return c.select("request_id", "status_code", "cleaned", user_facing_answer("cleaned").alias("answer"))


def generate_answers(spark, sf):
    """K3 end to end: prompts -> generator (built-in demo) -> F11 marker parsing."""
    from docweave.operators.generation import generate

    raw = generate(build_prompt(spark, sf))
    p = raw.select("conv_id", _parse("raw_response").alias("p"))
    return p.select("conv_id", F.col("p.text").alias("answer"), F.col("p.source").cast("string").alias("source"))


QUERIES = {
    "generate_answers": generate_answers,
    "truncate_context": truncate_context,
    "build_prompt": build_prompt,
    "demo_answer": demo_answer,
    "parse_source_marker": parse_source_marker,
    "classify_error": classify_error,
}

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_MARK = "^\\s*\\**[ \\t\\f\\v]*\\[SOURCE:([01])\\][ \\t\\f\\v]*\\**[ \\t\\f\\v]*"
_DOC_TEXT, _DOC_SRC = _answer_sql("text")


def _parse_sql(raw: str) -> tuple[str, str]:
    has = f"regexp_matches({raw}, '{_MARK}')"
    text = (f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN {raw} WHEN {has} THEN {_STRIP.format(x=f'regexp_replace({raw}, {chr(39)}{_MARK}{chr(39)}, {chr(39)}{chr(39)})')} "
            f"ELSE {_STRIP.format(x=raw)} END")
    src = f"CASE WHEN {has} THEN regexp_extract({raw}, '{_MARK}', 1) END"
    return text, src


_PT, _PS = _parse_sql("raw")

_PROMPT_SQL = None  # assembled below


def _prompt_sql():
    from docweave.plans.search_queries import _CHUNK_SEARCH, _SEARCH_OUT
    head = C.SYSTEM_PROMPT_HEAD.replace("'", "''").replace("\n", "' || chr(10) || '")
    tail = C.SYSTEM_PROMPT_TAIL.replace("'", "''").replace("\n", "' || chr(10) || '")
    trunc = (f"CASE WHEN length(coalesce(context, '')) > {C.MAX_CONTEXT_CHARS} THEN substring(context, 1, {C.MAX_CONTEXT_CHARS}) || chr(10) || chr(10) || '...[Truncated context]...' "
             f"ELSE coalesce(context, '') END")
    return _CHUNK_SEARCH + f""",
    snip AS ({_SEARCH_OUT}),
    ctx AS (SELECT query_id, string_agg('Source (' || filename || '): ' || chunk_text, chr(10) || chr(10) ORDER BY rank) AS context FROM snip GROUP BY query_id),
    t AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
    pairs AS (SELECT conv_id, turn AS user_turn, text AS "user", CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS assistant FROM t WHERE role = 'user'),
    lastt AS (SELECT conv_id, max(user_turn) AS last_turn FROM pairs GROUP BY conv_id),
    finalq AS (SELECT p.conv_id, p."user" AS query, p.user_turn FROM pairs p JOIN lastt l ON p.conv_id = l.conv_id AND p.user_turn = l.last_turn),
    hist AS (SELECT p.* FROM pairs p JOIN lastt l ON p.conv_id = l.conv_id AND p.user_turn < l.last_turn
             QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.user_turn DESC) <= {C.MAX_CONVERSATION_HISTORY}),
    hmsg AS (
      SELECT conv_id, user_turn * 2 AS o, 'user' AS role, "user" AS content FROM hist WHERE coalesce("user", '') <> ''
      UNION ALL SELECT conv_id, user_turn * 2 + 1, 'assistant', assistant FROM hist WHERE coalesce(assistant, '') <> ''),
    sysm AS (
      SELECT f.conv_id, -1 AS o, 'system' AS role,
             '{head}' || 'CONTEXT: ' || coalesce(nullif({trunc}, ''), '[None]') || '{tail}' AS content
      FROM finalq f LEFT JOIN ctx c ON c.query_id = CAST(f.conv_id AS VARCHAR) || ':' || CAST(f.user_turn AS VARCHAR)),
    allm AS (SELECT * FROM sysm UNION ALL SELECT * FROM hmsg UNION ALL SELECT conv_id, 1000000, 'user', query FROM finalq)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS BIGINT) AS msg_index, role, content FROM allm"""


def _generate_sql():
    ctx0 = "regexp_extract(content, '(?s)CONTEXT: (.*)' || chr(10) || chr(10) || 'If the answer comes from provided documents', 1)"
    gen_text, _ = _answer_sql("ctx")
    pt, ps = _parse_sql("raw")
    return f"""
    WITH p AS ({_prompt_sql()}),
    s AS (SELECT conv_id, CASE WHEN {ctx0} = '[None]' THEN '' ELSE {ctx0} END AS ctx FROM p WHERE role = 'system'),
    g AS (SELECT conv_id, {gen_text} AS raw FROM s)
    SELECT conv_id, {pt} AS answer, {ps} AS source FROM g"""


ORACLE = {
    "truncate_context": f"""
        SELECT conv_id,
               CASE WHEN length(ctx) > {C.MAX_CONTEXT_CHARS} THEN substring(ctx, 1, {C.MAX_CONTEXT_CHARS}) || chr(10) || chr(10) || '...[Truncated context]...' ELSE ctx END AS context,
               CAST(length(ctx) AS BIGINT) AS n_chars, length(ctx) > {C.MAX_CONTEXT_CHARS} AS is_truncated
        FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS ctx FROM conversations GROUP BY conv_id)""",
    "build_prompt": _prompt_sql(),
    "generate_answers": _generate_sql(),
    "demo_answer": f"SELECT doc_id, {_DOC_TEXT} AS answer, CASE WHEN NOT (text IS NULL OR regexp_matches(text, '^\\s*$')) THEN CAST({_DOC_SRC} AS VARCHAR) END AS source FROM documents",
    "parse_source_marker": f"""
        WITH raw AS (
          SELECT 'answer' AS kind, CAST(doc_id AS VARCHAR) AS id, {_DOC_TEXT} AS raw FROM documents
          UNION ALL SELECT 'turn', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'assistant')
        SELECT kind, id, {_PT} AS text, {_PS} AS source FROM raw""",
    "classify_error": f"""
        WITH r AS (
          SELECT event_id AS request_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'),
        c AS (SELECT request_id, CASE WHEN k % 2 = 0 THEN 400 ELSE 500 END AS status_code,
                     'request failed k=' || CAST(k AS VARCHAR) || CASE WHEN request_id % 3 = 0 THEN ' Content_Filter hit' WHEN request_id % 7 = 0 THEN ' ResponsibleAIPolicyViolation' ELSE '' END AS error FROM r)
        SELECT request_id, status_code,
               CASE WHEN contains(lower(error), 'content_filter') OR contains(lower(error), 'responsibleaipolicyviolation') OR status_code = 400
                    THEN '{C.CONTENT_FILTER_MARKER}' ELSE '{C.GENERIC_FAILURE_ANSWER}' END AS cleaned,
               CASE WHEN contains(lower(error), 'content_filter') OR contains(lower(error), 'responsibleaipolicyviolation') OR status_code = 400
                    THEN '{C.CONTENT_BLOCKED_ANSWER}' ELSE '{C.GENERIC_FAILURE_ANSWER}' END AS answer
        FROM c""",
}
