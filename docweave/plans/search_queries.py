"""Registered queries: search, thresholds, sources, contexts, answers."""

from __future__ import annotations


from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions.answers import route_answer
from docweave.operators import search as S
from docweave.operators.collection import scroll as scroll_page
from docweave.operators.filters import metadata_filter
from docweave.sources.tables import table
from docweave.plans.text_queries import _SYN
from docweave.plans.sql_blocks import chunk_points_ctes, hash_embed_sql
from docweave.functions.text import expand_query, py_strip
from docweave.functions.vectors import cosine, dot, with_hash_embedding
from docweave.plans.views import question_id, chunk_points, embedding_payload, embedding_vectors, label_centroid_queries, question_queries

FILTER = {"file_type": "en", "date_from": "2024-01-05", "date_to": "2024-02-10"}


def topk_search(spark, sf):
    return S.search(chunk_points(spark, sf), question_queries(spark, sf), C.TOP_K)


def filtered_search(spark, sf):
    pts = metadata_filter(chunk_points(spark, sf), FILTER)
    return S.search(pts, question_queries(spark, sf), C.TOP_K)


def matrix_topk(spark, sf):
    h = S.exact_topk(embedding_vectors(spark, sf), label_centroid_queries(spark, sf), C.TOP_K)
    return h.select("query_id", "rank", "point_id", "score")


WIDE = 300  # hits per query, enough that some lie below every threshold


def score_threshold(spark, sf):
    fetch = WIDE
    h = S.store_threshold(S.exact_topk(embedding_vectors(spark, sf), label_centroid_queries(spark, sf), fetch))
    return h.select("query_id", "rank", "point_id", "score", (F.col("score") > C.SIMILARITY_THRESHOLD).alias("above_hit_threshold"))


def relative_confidence(spark, sf):
    h = S.exact_topk(embedding_vectors(spark, sf), label_centroid_queries(spark, sf), WIDE)
    return S.relative_confidence(h).select("query_id", "rank", "point_id", "score")


def search_index_sources(spark, sf):
    h = S.search_index_hits(embedding_vectors(spark, sf), label_centroid_queries(spark, sf), C.TOP_K, payload_from=embedding_payload(spark, sf))
    return S.search_index_sources(h)


def search_index_context(spark, sf):
    h = S.search_index_hits(embedding_vectors(spark, sf), label_centroid_queries(spark, sf), C.TOP_K, payload_from=embedding_payload(spark, sf))
    return S.search_index_context(h).select("query_id", "context", F.col("n_chunks").cast("bigint"))


def distinct_sources(spark, sf):
    return S.distinct_sources(topk_search(spark, sf))


def build_context(spark, sf):
    c = S.build_context(topk_search(spark, sf))
    return c.select("query_id", "context", F.col("n_hits").cast("bigint"))


def search_response(spark, sf):
    """The demo ``/search`` answer per query: P6-confident hits -> A9 context -> F15/F16, plus A8 sources."""
    parts = S.response_parts(topk_search(spark, sf))
    q = question_queries(spark, sf).select("query_id")
    r = q.join(parts, "query_id", "left")
    return r.select("query_id", route_answer(F.col("n_used"), F.col("context")).alias("answer"),
                    F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_used", F.lit(0)).cast("bigint").alias("n_used"))


def cosine_search(spark, sf):
    """Vectors that are not of unit length, ranked by cosine: long ones gain nothing."""
    long_ = F.transform("vector", lambda x: x.cast("double") * (1 + F.pmod(F.col("point_id").cast("bigint"), F.lit(7))))
    pts = embedding_vectors(spark, sf).select("point_id", long_.alias("vector"))
    h = S.exact_topk(pts, label_centroid_queries(spark, sf), C.TOP_K)
    return h.select("query_id", "rank", "point_id", "score")


def _with_centroid(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("query_id"), "embedding")
    return e.join(label_centroid_queries(spark, sf), "query_id")


def vector_dot(spark, sf):
    """F5 of each vector and its label's centroid, whole and cut to 32 places (the shorter length counts)."""
    return _with_centroid(spark, sf).select(
        "vec_id", F.round(dot("embedding", "vector"), 6).alias("dot"), F.round(dot("embedding", F.slice("vector", 1, 32)), 6).alias("dot_cut"))


def vector_cosine(spark, sf):
    """F6 of each vector and its label's centroid times three; null against a zero vector."""
    longer = F.transform("vector", lambda x: x * 3.0)
    zero = F.transform("vector", lambda x: x * 0.0)
    return _with_centroid(spark, sf).select(
        "vec_id", F.round(cosine("embedding", longer), 6).alias("cosine"), cosine("embedding", zero).alias("with_zero"))


def _expanded_questions(spark, sf):
    """Valid user turns (P9), expanded by F8, as query vectors."""
    u = table(spark, sf, "conversations").where(F.col("role") == "user")
    # every third question names a product that F8 expands; every eleventh is blank
    text = F.when(F.pmod("conv_id", F.lit(11)) == 0, F.lit("  ")).when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("outlook login "), "text")).otherwise(F.col("text"))
    q = u.select(question_id("conv_id", "turn").alias("query_id"), py_strip(text).alias("asked")).where(F.col("asked") != "")
    return with_hash_embedding(q.select("query_id", expand_query("asked").alias("query")), "query", "vector", 64)


def search_index_end_to_end(spark, sf):
    """Query text -> F8 -> embedding -> P1 filter -> W2 over-fetch, P5 thresholds -> P4, W3, P7 -> context and sources."""
    points = metadata_filter(chunk_points(spark, sf), FILTER)
    hits = S.search_index_hits(points, _expanded_questions(spark, sf), C.TOP_K)
    sources = F.array_sort(F.collect_list(F.when(F.col("is_new_title"), F.struct("rank", "title"))))
    blocks = F.array_sort(F.collect_list(F.struct("rank", "block")))
    g = hits.groupBy("query_id").agg(sources.alias("s"), blocks.alias("b"), F.count(F.lit(1)).alias("n_chunks"))
    return g.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"),
                    F.array_join(F.transform("s", lambda x: x["title"]), " | ").alias("sources"), F.col("n_chunks").cast("bigint"))


def scroll(spark, sf):
    """The third page of 50 points in key order."""
    points = embedding_payload(spark, sf).select("point_id", "filename")
    second = scroll_page(points, 100).agg(F.max("point_id").alias("last")).first()["last"]  # the key a client would send back
    return scroll_page(points, 50, after=second)


QUERIES = {
    "scroll": scroll,
    "cosine_search": cosine_search,
    "vector_dot": vector_dot,
    "vector_cosine": vector_cosine,
    "search_index_end_to_end": search_index_end_to_end,
    "topk_search": topk_search,
    "filtered_search": filtered_search,
    "matrix_topk": matrix_topk,
    "score_threshold": score_threshold,
    "relative_confidence": relative_confidence,
    "search_index_sources": search_index_sources,
    "search_index_context": search_index_context,
    "distinct_sources": distinct_sources,
    "build_context": build_context,
    "search_response": search_response,
}

# ----------------------------------------------------------------------------- oracle

QUESTIONS_CTE = """
    qtext AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query
              FROM conversations WHERE role = 'user'),
    queries AS (""" + hash_embed_sql("qtext", "query_id", "query", 64) + ")"

EMB_CTES = """
    epoints AS (
      SELECT CAST(e.vec_id AS VARCHAR) AS point_id, e.vec_id AS doc_id, 'file_' || CAST(e.label AS VARCHAR) || '.pdf' AS filename,
             d.text, CAST(e.embedding AS DOUBLE[]) AS vec
      FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
    cent_dims AS (
      SELECT label, pos, avg(x) AS v FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
      GROUP BY label, pos),
    cent_raw AS (SELECT CAST(label AS BIGINT) AS query_id, list(v ORDER BY pos) AS raw FROM cent_dims GROUP BY label),
    centroids AS (
      SELECT query_id, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS vec FROM cent_raw)"""


_COSINE = "round(list_dot_product(p.vec, q.vec) / (sqrt(list_dot_product(p.vec, p.vec)) * sqrt(list_dot_product(q.vec, q.vec))), 6)"


def _topk(points: str, queries: str, k: int, cols: str) -> str:
    return f"""
    SELECT * FROM (
      SELECT q.query_id, {cols}, {_COSINE} AS score,
             row_number() OVER (PARTITION BY q.query_id ORDER BY {_COSINE} DESC, p.point_id) AS rank
      FROM {points} p, {queries} q WHERE len(p.vec) = len(q.vec)) WHERE rank <= {k}"""


_SNIP = "CASE WHEN length(coalesce(text, '')) > 400 THEN substring(text, 1, 400) || '...' ELSE coalesce(text, '') END"
_SEARCH_COLS = "p.point_id, p.doc_id, coalesce(p.filename, 'unknown') AS filename, p.text"
_SEARCH_OUT = f"SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, doc_id, filename, {_SNIP} AS chunk_text, score FROM hits"

_CHUNK_SEARCH = "WITH RECURSIVE " + chunk_points_ctes(64) + "," + QUESTIONS_CTE + ",\n    hits AS (" + _topk("points", "queries", C.TOP_K, _SEARCH_COLS) + ")"
_FILTERED_SEARCH = (
    "WITH RECURSIVE " + chunk_points_ctes(64) + "," + QUESTIONS_CTE
    + ",\n    fpoints AS (SELECT * FROM points WHERE type = 'EN' AND uploaded_at >= TIMESTAMP '2024-01-05' AND uploaded_at < TIMESTAMP '2024-02-11'),"
    + "\n    hits AS (" + _topk("fpoints", "queries", C.TOP_K, _SEARCH_COLS) + ")"
)
_EMB = "WITH " + EMB_CTES


def _si_hits(points: str, queries: str) -> str:
    return ",\n    f AS (" + _topk(points, queries, min(2 * C.TOP_K, C.MAX_SEARCH_LIMIT), "p.point_id, p.filename, p.text") + """),
    g AS (SELECT *, replace(replace(replace(coalesce(filename, 'Document'), '.pdf', ''), '.docx', ''), '_', ' ') AS title
          FROM f WHERE score >= 0.15 AND score > 0.3 AND coalesce(text, '') <> ''),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id, title ORDER BY rank) = 1 AS is_new_title FROM g),
    i AS (SELECT *, coalesce(sum(CAST(is_new_title AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
    sel AS (SELECT *, CASE WHEN length(title) > 0 AND NOT contains(lower(substring(text, 1, 100)), lower(title))
                           THEN '**' || title || '**' || chr(10) || chr(10) || text ELSE text END AS block
            FROM i WHERE before < 5)"""


_SI_HITS = _EMB + _si_hits("epoints", "centroids")

_CONF = "hits2 AS (SELECT * FROM hits QUALIFY score >= greatest(max(score) OVER (PARTITION BY query_id) * 0.6, 0.0))"


def _answer_sql(ctx: str) -> str:
    blocks = f"list_slice(list_filter(list_transform(string_split({ctx}, chr(10) || chr(10)), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> ''), 1, 3)"
    body0 = f"array_to_string({blocks}, chr(10) || chr(10))"
    body = f"CASE WHEN length({body0}) > 800 THEN regexp_replace(substring({body0}, 1, 797), '\\s+$', '') || '...' ELSE {body0} END"
    src = f"CASE WHEN contains(lower({body}), 'microsoft') OR contains(lower({body}), 'windows') OR contains(lower({body}), 'office') THEN 1 ELSE 0 END"
    text = f"CASE WHEN {ctx} IS NULL OR regexp_matches({ctx}, '^\\s*$') THEN '{C.NO_CONTEXT_ANSWER}' ELSE '[SOURCE:' || CAST({src} AS VARCHAR) || ']' || chr(10) || {body} END"
    return text, src


_ANSWER_TEXT, _ANSWER_SRC = _answer_sql("context")

_EXPANDED_CTE = """
    asked0 AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '  ' WHEN conv_id % 3 = 0 THEN 'outlook login ' || text ELSE text END AS t
               FROM conversations WHERE role = 'user'),
    asked1 AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS q FROM asked0),
    qtext AS (SELECT query_id, """ + _SYN + """ AS query FROM asked1 WHERE q <> ''),
    queries AS (""" + hash_embed_sql("qtext", "query_id", "query", 64) + ")"

ORACLE = {
    "scroll": "SELECT CAST(vec_id AS VARCHAR) AS point_id, 'file_' || CAST(label AS VARCHAR) || '.pdf' AS filename FROM embeddings ORDER BY point_id LIMIT 50 OFFSET 100",
    "cosine_search": _EMB + ",\n    lpoints AS (SELECT point_id, list_transform(vec, lambda x: x * (1 + CAST(point_id AS BIGINT) % 7)) AS vec FROM epoints),\n    hits AS (" + _topk("lpoints", "centroids", C.TOP_K, "p.point_id") + ")\n    SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, score FROM hits",
    "search_index_end_to_end": "WITH RECURSIVE " + chunk_points_ctes(64) + "," + _EXPANDED_CTE
    + ",\n    fpoints AS (SELECT * FROM points WHERE type = 'EN' AND uploaded_at >= TIMESTAMP '2024-01-05' AND uploaded_at < TIMESTAMP '2024-02-11')"
    + _si_hits("fpoints", "queries") + """
    SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context,
           coalesce(string_agg(title, ' | ' ORDER BY rank) FILTER (WHERE is_new_title), '') AS sources, CAST(count(*) AS BIGINT) AS n_chunks
    FROM sel GROUP BY query_id""",
    "vector_dot": _EMB + """
    SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.vec), 6) AS dot,
           round(list_dot_product(CAST(e.embedding[1:32] AS DOUBLE[]), c.vec[1:32]), 6) AS dot_cut
    FROM embeddings e JOIN centroids c ON c.query_id = e.label""",
    "vector_cosine": _EMB + """
    SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.vec), 6) AS cosine, CAST(NULL AS DOUBLE) AS with_zero
    FROM embeddings e JOIN centroids c ON c.query_id = e.label""",
    "topk_search": _CHUNK_SEARCH + _SEARCH_OUT,
    "filtered_search": _FILTERED_SEARCH + _SEARCH_OUT,
    "matrix_topk": _EMB + ",\n    hits AS (" + _topk("epoints", "centroids", C.TOP_K, "p.point_id") + ")\n    SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, score FROM hits",
    "score_threshold": _EMB + ",\n    hits AS (" + _topk("epoints", "centroids", WIDE, "p.point_id") + ")\n    SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, score, score > 0.3 AS above_hit_threshold FROM hits WHERE score >= 0.15",
    "relative_confidence": _EMB + ",\n    hits AS (" + _topk("epoints", "centroids", WIDE, "p.point_id") + "),\n    " + _CONF + "\n    SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, score FROM hits2",
    "search_index_sources": _SI_HITS + "\n    SELECT query_id, CAST(rank AS INTEGER) AS rank, title, round(score, 3) AS similarity_score FROM sel WHERE is_new_title",
    "search_index_context": _SI_HITS + "\n    SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS BIGINT) AS n_chunks FROM sel GROUP BY query_id",
    "distinct_sources": _CHUNK_SEARCH + "\n    SELECT query_id, string_agg(DISTINCT filename, ', ' ORDER BY filename) AS sources FROM hits GROUP BY query_id",
    "build_context": _CHUNK_SEARCH + f""",
    snip AS ({_SEARCH_OUT})
    SELECT query_id, string_agg('Source (' || filename || '): ' || chunk_text, chr(10) || chr(10) ORDER BY rank) AS context,
           CAST(count(*) AS BIGINT) AS n_hits FROM snip GROUP BY query_id""",
    "search_response": _CHUNK_SEARCH + f""",
    snip AS ({_SEARCH_OUT}),
    hits2 AS (SELECT * FROM snip QUALIFY score >= greatest(max(score) OVER (PARTITION BY query_id) * 0.6, 0.0)),
    ctx AS (SELECT query_id, string_agg('Source (' || filename || '): ' || chunk_text, chr(10) || chr(10) ORDER BY rank) AS context,
                   count(*) AS n_hits FROM hits2 GROUP BY query_id),
    src AS (SELECT query_id, string_agg(DISTINCT filename, ', ' ORDER BY filename) AS sources FROM snip GROUP BY query_id)
    SELECT q.query_id,
           CASE WHEN coalesce(ctx.n_hits, 0) = 0 THEN '{C.NO_MATCH_ANSWER.replace("'", "''")}'
                ELSE '{C.DEMO_PREFIX}' || ({_ANSWER_TEXT}) END AS answer,
           coalesce(src.sources, '') AS sources, CAST(coalesce(ctx.n_hits, 0) AS BIGINT) AS n_used
    FROM qtext q LEFT JOIN ctx USING (query_id) LEFT JOIN src USING (query_id)""",
}
