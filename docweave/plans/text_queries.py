"""Registered queries: text preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import config as C
from docweave.functions import text as T
from docweave.functions.vectors import with_hash_embedding
from docweave.operators.arrays import posexplode_kept
from docweave.operators.chunker import chunk_documents
from docweave.operators.dictionary import expand_by_dictionary, with_terms
from docweave.plans.sql_blocks import DOCS_CTE, chunk_ctes, hash_embed_sql
from docweave.sources.tables import docs_view, table


def normalize_text(spark, sf):
    d = table(spark, sf, "documents")
    n = T.normalize_ws("text")
    return d.select("doc_id", n.alias("text"), F.length(n).cast("bigint").alias("n_chars"))


def sentence_split(spark, sf):
    d = table(spark, sf, "documents")
    s = d.select("doc_id", T.split_sentences(T.normalize_ws("text")).alias("s"))
    e = posexplode_kept(s, ["doc_id"], "s", "sentence_index", "sentence")
    return e.select("doc_id", F.col("sentence_index").cast("bigint"), "sentence",
                    F.size(F.split("sentence", " ")).cast("bigint").alias("n_words"))


def chunk_docs(spark, sf):
    c = chunk_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return c.select("doc_id", F.col("chunk_index").cast("bigint"), "chunk_text",
                    F.size(F.split("chunk_text", " ")).cast("bigint").alias("n_words"))


def hash_embed(spark, sf):
    d = with_hash_embedding(table(spark, sf, "documents").select("doc_id", "text"), "text", "vec", 64)
    e = posexplode_kept(d, ["doc_id"], "vec", "dim_index", "value")
    return e.select("doc_id", F.col("dim_index").cast("bigint"), F.round("value", 6).alias("value"))


def payload_fields(spark, sf):
    d = docs_view(spark, sf)
    return d.select(
        "doc_id", "filename", "type",
        T.file_type(F.col("filename"), "FILE").alias("type_adapter"),
        T.file_type(F.split("filename", "_")[0]).alias("type_no_ext"),
        T.title_of(F.col("filename")).alias("title"),
        T.snippet("text").alias("snippet"),
        F.date_format("uploaded_at", "yyyy-MM-dd HH:mm").alias("uploaded_at"),
    )


def _user_turns(spark, sf):
    return table(spark, sf, "conversations").where(F.col("role") == "user")


#: What user turns are made into, by conv_id mod 9, so that every rule meets text it decides on ("@" is the turn).
ASKED = ["@", "outlook printer @", "recipe for @", "Windows cooking @", "12 + 7 * (3 - 1)", "what is 12 plus 7", "  ", "teams login password @", "@ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @ @"]


def asked(spark, sf):
    """The user turns, some turned into questions of each kind that the rules tell apart."""
    kind = F.element_at(F.array(*map(F.lit, ASKED)), (F.pmod("conv_id", F.lit(len(ASKED))) + 1).cast("int"))
    return _user_turns(spark, sf).select("conv_id", "turn", F.replace(kind, F.lit("@"), F.coalesce("text", F.lit(""))).alias("text"))


def expand_query(spark, sf):
    q = asked(spark, sf)
    return q.select("conv_id", "turn", T.expand_query("text").alias("expanded"))


def classify_domain(spark, sf):
    c = asked(spark, sf)
    b = table(spark, sf, "benchmark").select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("item_id").alias("turn"), "text")
    u = c.unionByName(b)
    d = u.select("conv_id", "turn", T.classify_domain("text").alias("d"), T.is_math("text").alias("is_math"))
    return d.select("conv_id", "turn", F.col("d.domain").alias("domain"), F.col("d.is_it").alias("is_it"), "is_math")


def validate_query(spark, sf):
    q = asked(spark, sf)
    v = q.select("conv_id", "turn", T.validate_query("text").alias("v"))
    return v.select("conv_id", "turn", F.col("v.is_valid").alias("is_valid"), F.col("v.message").alias("message"))


def expand_query_terms(spark, sf):
    """F8 with the synonyms as a table of terms."""
    synonyms = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(C.SYNONYMS)], "ord long, term string, value string")
    return expand_by_dictionary(asked(spark, sf), synonyms).select("conv_id", "turn", "expanded")


def match_terms(spark, sf):
    """The words of ten letters or more of the benchmark, looked for in all documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0))).alias("term"))
    terms = words.distinct().select(F.length("term").cast("long").alias("ord"), "term", F.lit(None).cast("string").alias("value"))
    found = with_terms(table(spark, sf, "documents").select("doc_id", "text"), terms)
    return found.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join(F.transform("terms", lambda e: e["term"]), ",").alias("terms"))


QUERIES = {
    "normalize_text": normalize_text,
    "sentence_split": sentence_split,
    "chunk_documents": chunk_docs,
    "hash_embed": hash_embed,
    "payload_fields": payload_fields,
    "expand_query": expand_query,
    "classify_domain": classify_domain,
    "validate_query": validate_query,
    "expand_query_terms": expand_query_terms,
    "match_terms": match_terms,
}

_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

_SYN = " || ".join(
    ["q"] + [f"CASE WHEN contains(lower(q), '{t}') THEN ' {x}' ELSE '' END" for t, x in __import__("docweave.config", fromlist=["SYNONYMS"]).SYNONYMS]
)


def _any(col, terms):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


def _domain_sql(col):
    from docweave import config as C
    blank = f"({col} IS NULL OR regexp_matches({col}, '^\\s*$'))"
    clean = f"regexp_replace(replace({col}, ' ', ''), '^\\s+|\\s+$', '', 'g')"
    math = (f"(NOT ({col} IS NULL OR {col} = '') AND (regexp_full_match({clean}, '[0-9+\\-*/()=.,\\s]*[+\\-*/][0-9+\\-*/()=.,\\s]*')"
            f" OR ({_any(f'lower({col})', C.MATH_WORDS)} AND regexp_matches({col}, '[0-9]'))))")
    dom = (f"CASE WHEN {blank} THEN 'unknown' WHEN {math} THEN 'math' WHEN {_any(f'lower({col})', C.NON_IT_TERMS)} THEN 'non_it' "
           f"WHEN {_any(f'lower({col})', C.IT_TERMS)} THEN 'it' ELSE 'unknown' END")
    return blank, math, dom


def _asked_sql():
    kinds = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(ASKED))
    return f"(SELECT conv_id, turn, replace(CASE conv_id % {len(ASKED)} {kinds} END, '@', coalesce(text, '')) AS text FROM conversations WHERE role = 'user')"


def _oracle():
    from docweave import config as C
    blank, math, dom = _domain_sql("text")
    return {
        "normalize_text": f"SELECT doc_id, {_NORM} AS text, CAST(length({_NORM}) AS BIGINT) AS n_chars FROM documents",
        "sentence_split": f"""
            WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents),
            sl AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM n WHERE t <> '')
            SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sentence_index, unnest(ss) AS sentence,
                   CAST(len(string_split(unnest(ss), ' ')) AS BIGINT) AS n_words FROM sl""",
        "chunk_documents": "WITH RECURSIVE " + chunk_ctes("documents") + """
            SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_text,
                   CAST(len(string_split(chunk_text, ' ')) AS BIGINT) AS n_words FROM ck_chunks""",
        "hash_embed": "WITH e AS (" + hash_embed_sql("documents", "doc_id", "text", 64) + """)
            SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim_index, round(unnest(vec), 6) AS value FROM e""",
        "payload_fields": "WITH " + DOCS_CTE + """
            SELECT doc_id, filename, type,
                   CASE WHEN contains(filename, '.') THEN upper(split_part(filename, '.', -1)) ELSE 'FILE' END AS type_adapter,
                   CASE WHEN contains(split_part(filename, '_', 1), '.') THEN upper(split_part(split_part(filename, '_', 1), '.', -1)) ELSE 'TXT' END AS type_no_ext,
                   replace(replace(replace(filename, '.pdf', ''), '.docx', ''), '_', ' ') AS title,
                   CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS snippet,
                   strftime(uploaded_at, '%Y-%m-%d %H:%M') AS uploaded_at
            FROM docs""",
        "expand_query": f"""
            SELECT conv_id, turn, {_SYN} AS expanded
            FROM (SELECT conv_id, turn, {_NORM} AS q FROM {_asked_sql()})""",
        "expand_query_terms": f"""
            SELECT conv_id, turn, {_SYN} AS expanded
            FROM (SELECT conv_id, turn, {_NORM} AS q FROM {_asked_sql()})""",
        "match_terms": """
            WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS term FROM benchmark)
            SELECT doc_id, count(term) AS n_terms, coalesce(string_agg(term, ',' ORDER BY length(term), term), '') AS terms
            FROM documents LEFT JOIN terms ON contains(lower(text), term) GROUP BY doc_id""",
        "classify_domain": f"""
            SELECT conv_id, turn, {dom} AS domain, CASE WHEN {blank} THEN false ELSE ({dom}) IN ('it', 'unknown') END AS is_it,
                   coalesce({math}, false) AS is_math
            FROM (SELECT conv_id, turn, text FROM {_asked_sql()}
                  UNION ALL SELECT CAST(-1 AS BIGINT), item_id, text FROM benchmark)""",
        "validate_query": f"""
            SELECT conv_id, turn, message IS NULL AS is_valid, message FROM (
              SELECT conv_id, turn,
                CASE WHEN {blank} THEN '{C.EMPTY_QUERY_MESSAGE}'
                     WHEN length(text) > {C.MAX_QUERY_CHARS} THEN '{C.LONG_QUERY_MESSAGE}'
                     WHEN ({dom}) = 'non_it' THEN '{C.NON_IT_MESSAGE.replace("'", "''")}' END AS message
              FROM {_asked_sql()})""",
    }


ORACLE = _oracle()
