"""DuckDB SQL building blocks for the oracle queries.

The oracle is an independent formulation of each operator in plain SQL over
the driver's tables; the Spark side never executes it.
"""

from __future__ import annotations

from docweave import config as C


def hash_embed_sql(src: str, id_cols: str, text_col: str, dim: int = C.HASH_DIM_DEFAULT) -> str:
    """``SELECT <id_cols>, vec`` with the F4 embedding of ``text_col`` (DOUBLE[])."""
    n = (dim + 15) // 16
    hs = ["md5(" + text_col + ") AS h0"] + [f"md5(unhex(h{i - 1})) AS h{i}" for i in range(1, n)]
    hx = " || ".join(f"h{i}" for i in range(n))
    return f"""
    SELECT {id_cols}, list_transform(raw, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(raw, lambda y: y * y))), 0), 1.0)) AS vec
    FROM (
      SELECT {id_cols},
             list_transform(range({dim}), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::INTEGER / 255.0::DOUBLE) AS raw
      FROM (SELECT {id_cols}, {hx} AS hx FROM (SELECT {id_cols}, {", ".join(hs)} FROM {src}))
    )"""


def chunk_ctes(src: str = "documents", id_col: str = "doc_id", text_col: str = "text",
               size: int = C.CHUNK_SIZE_WORDS, overlap: int = C.CHUNK_OVERLAP_WORDS, prefix: str = "ck") -> str:
    """CTEs ending in ``{prefix}_chunks(doc_id, chunk_index, chunk_text)``.

    Needs ``WITH RECURSIVE``. Greedy packing as a recursion over chunk starts,
    with the two searches (last sentence that fits, carry start) as interval joins.
    """
    p = prefix
    return f"""
    {p}_norm AS (SELECT {id_col} AS doc_id, trim(regexp_replace({text_col}, '\\s+', ' ', 'g')) AS t FROM {src}),
    {p}_sl AS (
      SELECT doc_id, string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS ss
      FROM {p}_norm WHERE t <> ''),
    {p}_sent AS (
      SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS idx, len(ss) AS n FROM {p}_sl),
    {p}_w AS (SELECT *, len(string_split(s, ' ')) AS w FROM {p}_sent),
    {p}_pre AS (
      SELECT doc_id, idx, s, w, n,
             sum(w) OVER (PARTITION BY doc_id ORDER BY idx) - w AS p,
             sum(w) OVER (PARTITION BY doc_id ORDER BY idx) AS pend
      FROM {p}_w),
    {p}_lim AS (SELECT doc_id, idx, n, p + {size} AS lim, pend - {overlap} AS carry_lim FROM {p}_pre),
    -- last sentence that still fits = the one before the sentence holding word position lim
    {p}_kt AS MATERIALIZED (
      SELECT x.doc_id, x.idx AS a, coalesce(y.idx - 1, x.n - 1) AS k
      FROM {p}_lim x LEFT JOIN {p}_pre y ON y.doc_id = x.doc_id AND y.p <= x.lim AND y.pend > x.lim),
    -- carry start = the sentence holding word position carry_lim (none when negative)
    {p}_ct AS MATERIALIZED (
      SELECT x.doc_id, x.idx AS e, coalesce(y.idx, -1) AS j
      FROM {p}_lim x LEFT JOIN {p}_pre y ON y.doc_id = x.doc_id AND y.p <= x.carry_lim AND y.pend > x.carry_lim),
    {p}_rec(doc_id, ci, a, f, n) AS (
      SELECT doc_id, 0, 0, 0, n FROM {p}_pre WHERE idx = 0
      UNION ALL
      SELECT c.doc_id, c.ci + 1, greatest(c.a, ct.j), greatest(c.f, kt.k) + 1, c.n
      FROM {p}_rec c
      JOIN {p}_kt kt ON kt.doc_id = c.doc_id AND kt.a = c.a
      JOIN {p}_ct ct ON ct.doc_id = c.doc_id AND ct.e = greatest(c.f, kt.k)
      WHERE greatest(c.f, kt.k) < c.n - 1),
    {p}_bounds AS (
      SELECT c.doc_id, c.ci, c.a, greatest(c.f, kt.k) AS e
      FROM {p}_rec c JOIN {p}_kt kt ON kt.doc_id = c.doc_id AND kt.a = c.a),
    {p}_chunks AS (
      SELECT b.doc_id, b.ci AS chunk_index, string_agg(x.s, ' ' ORDER BY x.idx) AS chunk_text
      FROM {p}_bounds b JOIN {p}_pre x ON x.doc_id = b.doc_id AND x.idx BETWEEN b.a AND b.e
      GROUP BY b.doc_id, b.ci)"""


DOCS_CTE = """
    docs AS (
      SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || '.' || lang AS filename,
             upper(lang) AS type, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS uploaded_at, text
      FROM documents)"""


def chunk_points_ctes(dim: int = C.HASH_DIM_DEFAULT) -> str:
    """CTEs ending in ``points(point_id, doc_id, filename, chunk_index, text, uploaded_at, type, vec)``."""
    return (
        DOCS_CTE
        + ","
        + chunk_ctes("docs")
        + """,
    pt0 AS (
      SELECT sha256(d.filename || '#' || CAST(c.chunk_index AS VARCHAR) || '#' || c.chunk_text) AS point_id,
             d.doc_id, d.filename, c.chunk_index, c.chunk_text AS text, d.uploaded_at, d.type
      FROM ck_chunks c JOIN docs d USING (doc_id)),
    pt_emb AS ("""
        + hash_embed_sql("pt0", "point_id", "text", dim)
        + """),
    points AS (SELECT pt0.*, pt_emb.vec FROM pt0 JOIN pt_emb USING (point_id))"""
    )
