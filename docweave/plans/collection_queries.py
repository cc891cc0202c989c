"""Registered queries: collection state and reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from docweave import config as C
from docweave.operators.arrays import posexplode_kept
from docweave.functions.vectors import hash_embed_raw, l2_normalize, with_hash_embedding
from docweave.operators import collection as K
from docweave.operators.chunker import chunk_documents
from docweave.plans.sql_blocks import DOCS_CTE, chunk_ctes, hash_embed_sql
from docweave.plans.views import chunk_points, point_id
from docweave.session import ensure_checkpoint_dir, scratch_path
from docweave.sources.tables import docs_view, table

TS = "yyyy-MM-dd HH:mm"


def _toxic_files(spark, sf):
    lab = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return docs_view(spark, sf).join(lab, "doc_id", "left_semi").select("doc_id", "filename")


def list_documents(spark, sf):
    l = K.list_documents(chunk_points(spark, sf))
    return l.select("filename", F.col("chunks").cast("bigint"), F.date_format("uploaded_at", TS).alias("uploaded_at"), "type")


def rebuild_document(spark, sf):
    r = K.rebuild_documents(chunk_points(spark, sf))
    return r.select("filename", "text", F.col("chunks").cast("bigint"))


def point_count(spark, sf):
    p = chunk_points(spark, sf)
    return K.point_count(p).select(F.lit("documents").alias("collection"), F.col("points").cast("bigint"))


def _new_collection(spark, dim=64):
    coll = K.Collection(spark, scratch_path(spark, f"collection-{uuid.uuid4().hex}"), "documents")
    coll.create(dim)
    return coll


def _stored_points(spark, sf):
    return chunk_points(spark, sf).select(*K.POINT_COLUMNS)


def _state(coll, step, result):
    """One row with what the collection holds, read back from its files, and what the step reported."""
    m = coll.meta()
    report = F.to_json(F.create_map(*[x for k, v in sorted(result.items()) for x in (F.lit(k), F.lit(str(v).lower()))]))
    return coll.read().agg(F.lit(step).alias("step"), F.lit(m["collection"]).alias("collection"), F.lit(m["dim"]).cast("bigint").alias("dim"), F.lit(m["distance"]).alias("distance"),
                           F.count(F.lit(1)).cast("bigint").alias("points"), report.alias("report"))


def create_collection(spark, sf):
    """U5 and U1 on a stored collection: created, filled, filled again, created anew; the state after each step."""
    coll = K.Collection(spark, scratch_path(spark, f"collection-{uuid.uuid4().hex}"), "documents")
    out = [_written(_state(coll, "new", coll.create(64)))]
    out.append(_written(_state(coll, "insert", coll.upsert(_stored_points(spark, sf)))))
    out.append(_written(_state(coll, "insert again", coll.upsert(coll.read()))))
    out.append(_written(_state(coll, "recreate", coll.create(32, mode="recreate", confirm=True, distance="Dot"))))
    return reduce(lambda a, b: a.unionByName(b), out)


def stored_changes(spark, sf):
    """U3, U2 on a stored collection: toxic files deleted, then the Spanish files replaced by their first chunks."""
    coll = _new_collection(spark)
    coll.upsert(_stored_points(spark, sf))
    coll.delete(_toxic_files(spark, sf).select("filename"))
    coll.replace(coll.read().where((F.col("type") == "ES") & (F.col("chunk_index") == 0)))
    return coll.read().select("point_id", "filename", F.col("chunk_index").cast("bigint"), "type")


def _written(df):
    path = scratch_path(df.sparkSession, f"state-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup_documents(spark, sf):
    """Chunks of the documents labelled high quality."""
    keys = docs_view(spark, sf).join(table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id"), "doc_id", "left_semi")
    l = K.lookup_documents(chunk_points(spark, sf), keys.select("filename"))
    return l.select("filename", F.col("chunk_index").cast("bigint"), "text")


def append_points(spark, sf):
    """U1 twice = once: the English points exist, then every point is inserted."""
    # the points are computed once and written (checkpoint under spark.checkpoint.dir):
    # the stored side of an insert is a table, not a second run of the pipeline
    ensure_checkpoint_dir(spark)
    pts = chunk_points(spark, sf).select("point_id", "filename", "chunk_index", "type").checkpoint()
    res = K.append_points(pts.where(F.col("type") == "EN"), pts)
    return res.select("point_id", "filename", F.col("chunk_index").cast("bigint"))


def replace_document(spark, sf):
    """Toxic-labelled documents re-chunked (100 words, overlap 25) replace their old points."""
    d = docs_view(spark, sf)
    old = chunk_points(spark, sf).select("filename", "chunk_index", "text")
    tox = d.join(_toxic_files(spark, sf).select("doc_id"), "doc_id", "left_semi")
    new = chunk_documents(tox, "text", keep=["filename"], size=100, overlap=25).select("filename", "chunk_index", F.col("chunk_text").alias("text"))
    res = K.replace_documents(old, new, keys=_toxic_files(spark, sf).select("filename"))
    return res.select("filename", F.col("chunk_index").cast("bigint"), F.size(F.split("text", " ")).cast("bigint").alias("n_words"))


def delete_document(spark, sf):
    """U3 report: toxic documents by name (found) and the same names with a .txt suffix (unknown -> 0)."""
    pts = chunk_points(spark, sf).select("filename")
    tox = _toxic_files(spark, sf)
    req = tox.select("filename").unionByName(tox.select(F.concat("filename", F.lit(".txt")).alias("filename")))
    return K.delete_report(pts, req)


def delete_state(spark, sf):
    """The collection after the toxic documents are deleted."""
    pts = chunk_points(spark, sf).select("point_id", "filename", "chunk_index")
    res = K.delete_documents(pts, _toxic_files(spark, sf).select("filename"))
    return res.select("point_id", "filename", F.col("chunk_index").cast("bigint"))


def clear_collection(spark, sf):
    """U4 on a stored collection: what clearing reports, and what is left."""
    coll = _new_collection(spark)
    coll.upsert(_stored_points(spark, sf))
    return _written(_state(coll, "clear", coll.clear()))


def _mixed_dim_points(spark, sf):
    """Upload batches where non-English documents were embedded by a 48-dim provider."""
    d = docs_view(spark, sf)
    c = chunk_documents(d, "text", keep=["doc_id", "filename", "type", "uploaded_at"])
    c = c.select(point_id(F.col("filename"), F.col("chunk_index"), F.col("chunk_text")).alias("point_id"), "filename", "chunk_index",
                 F.col("chunk_text").alias("text"), "uploaded_at", "type")
    # one pass: the raw values of whichever dimension applies, then one normalisation
    raw = F.when(F.col("type") == "EN", hash_embed_raw(F.col("text"), 64)).otherwise(hash_embed_raw(F.col("text"), 48))
    return c.withColumn("__raw", raw).withColumn("vector", l2_normalize("__raw")).drop("__raw")


def dim_guard(spark, sf):
    s = K.upload_status(_mixed_dim_points(spark, sf), 64)
    return s.select("filename", F.col("requested_chunks").cast("bigint"), "status")


def reindex_split(spark, sf):
    r = K.reindex(_mixed_dim_points(spark, sf), 64, lambda df, t, o: with_hash_embedding(df, t, o, 64))
    g = r.groupBy("filename").agg(F.count_if("reindex_ok").alias("upserted"), F.count_if("reembedded").alias("reembedded"),
                                  F.count_if(~F.col("reindex_ok")).alias("failed"),
                                  F.sum(F.try_element_at("vector", F.lit(1))).alias("v0"))
    return g.select("filename", "upserted", "reembedded", "failed", F.round("v0", 6).alias("v0_sum"))


def dim_guard_sides(spark, sf):
    """The points that the guard takes and those that it turns away, with their dimension."""
    sides = K.dim_guard(_written(_mixed_dim_points(spark, sf)), 64)
    took, refused = (x.select("point_id", "filename", F.lit(side).alias("side"), F.size("vector").cast("bigint").alias("dim"))
                     for x, side in zip(sides, ("accepted", "rejected"), strict=True))
    return took.unionByName(refused)


def reindex_vectors(spark, sf):
    """Every place of every vector after reindexing."""
    r = K.reindex(_mixed_dim_points(spark, sf), 64, lambda df, t, o: with_hash_embedding(df, t, o, 64))
    places = posexplode_kept(r, ["point_id", "filename"], "vector", "dim_index", "value")
    return places.select("point_id", "filename", F.col("dim_index").cast("bigint"), F.round("value", 6).alias("value"))


def ingest_report(spark, sf):
    """U8; the provider gave no vector for every fifth chunk of a document."""
    given = F.when(F.pmod("chunk_index", F.lit(5)) != 3, F.col("vector"))
    r = K.ingest_report(chunk_points(spark, sf).withColumn("vector", given))
    return r.select("filename", "requested_chunks", "embedded_chunks", "failed_chunks")


def collection_search(spark, sf):
    """Store-backed search: points written to a collection (partitioned by type),
    read back with the P1 filter pruning partitions, then searched."""
    from docweave.operators.filters import metadata_filter
    from docweave.operators.search import search
    from docweave.plans.search_queries import FILTER
    from docweave.plans.views import question_queries

    coll = _new_collection(spark)
    coll.upsert(_stored_points(spark, sf))
    points = metadata_filter(coll.read(), FILTER)
    return search(points, question_queries(spark, sf), payload_from=points, distance=coll.meta()["distance"])


QUERIES = {
    "collection_search": collection_search,
    "list_documents": list_documents,
    "rebuild_document": rebuild_document,
    "point_count": point_count,
    "create_collection": create_collection,
    "stored_changes": stored_changes,
    "lookup_documents": lookup_documents,
    "append_points": append_points,
    "replace_document": replace_document,
    "delete_document": delete_document,
    "delete_state": delete_state,
    "clear_collection": clear_collection,
    "dim_guard": dim_guard,
    "dim_guard_sides": dim_guard_sides,
    "reindex_split": reindex_split,
    "reindex_vectors": reindex_vectors,
    "ingest_report": ingest_report,
}

_CK = "WITH RECURSIVE " + DOCS_CTE + "," + chunk_ctes("docs") + """,
    pts AS (SELECT sha256(d.filename || '#' || CAST(c.chunk_index AS VARCHAR) || '#' || c.chunk_text) AS point_id, d.doc_id,
                   d.filename, c.chunk_index, c.chunk_text AS text, d.uploaded_at, d.type
            FROM ck_chunks c JOIN docs d USING (doc_id)),
    tox AS (SELECT d.doc_id, d.filename FROM docs d SEMI JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1)"""

_MIXED = _CK + """,
    e64 AS (""" + hash_embed_sql("(SELECT * FROM pts WHERE type = 'EN')", "point_id", "text", 64) + """),
    e48 AS (""" + hash_embed_sql("(SELECT * FROM pts WHERE type <> 'EN')", "point_id", "text", 48) + """),
    mixed AS (SELECT p.*, coalesce(a.vec, b.vec) AS vec FROM pts p LEFT JOIN e64 a USING (point_id) LEFT JOIN e48 b USING (point_id))"""

def _collection_search_sql():
    from docweave.plans.search_queries import _FILTERED_SEARCH, _SNIP
    return _FILTERED_SEARCH + f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, point_id AS doc_id, filename, {_SNIP} AS chunk_text, score FROM hits"""


ORACLE = {
    "collection_search": _collection_search_sql(),
    "list_documents": _CK + """
    SELECT filename, CAST(count(*) AS BIGINT) AS chunks, strftime(min(uploaded_at), '%Y-%m-%d %H:%M') AS uploaded_at, min(type) AS type
    FROM pts GROUP BY filename""",
    "rebuild_document": _CK + """
    SELECT filename, string_agg(text, chr(10) ORDER BY chunk_index) AS text, CAST(count(*) AS BIGINT) AS chunks FROM pts GROUP BY filename""",
    "point_count": _CK + "\n    SELECT 'documents' AS collection, CAST(count(*) AS BIGINT) AS points FROM pts",
    "create_collection": _CK + """,
    n AS (SELECT count(*) AS n FROM pts)
    SELECT 'new' AS step, 'documents' AS collection, CAST(64 AS BIGINT) AS dim, 'Cosine' AS distance, CAST(0 AS BIGINT) AS points,
           '{"collection":"documents","size":"64","status":"created"}' AS report
    UNION ALL SELECT 'insert', 'documents', 64, 'Cosine', n, '{"inserted":"' || CAST(n AS VARCHAR) || '","status":"indexed"}' FROM n
    UNION ALL SELECT 'insert again', 'documents', 64, 'Cosine', n, '{"inserted":"0","status":"indexed"}' FROM n
    UNION ALL SELECT 'recreate', 'documents', 32, 'Dot', 0, '{"collection":"documents","size":"32","status":"recreated"}'""",
    "stored_changes": _CK + """
    SELECT point_id, filename, CAST(chunk_index AS BIGINT) AS chunk_index, type FROM pts
    WHERE filename NOT IN (SELECT filename FROM tox) AND (type <> 'ES' OR chunk_index = 0)""",
    "lookup_documents": _CK + """
    SELECT filename, CAST(chunk_index AS BIGINT) AS chunk_index, text FROM pts
    WHERE filename IN (SELECT d.filename FROM docs d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1)""",
    "append_points": _CK + "\n    SELECT DISTINCT point_id, filename, CAST(chunk_index AS BIGINT) AS chunk_index FROM pts",
    "replace_document": "WITH RECURSIVE " + DOCS_CTE + "," + chunk_ctes("docs") + "," + chunk_ctes("(SELECT d.* FROM docs d SEMI JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1)", size=100, overlap=25, prefix="rk") + """,
    oldp AS (SELECT d.filename, c.chunk_index, c.chunk_text AS text FROM ck_chunks c JOIN docs d USING (doc_id)),
    newp AS (SELECT d.filename, c.chunk_index, c.chunk_text AS text FROM rk_chunks c JOIN docs d USING (doc_id)),
    res AS (SELECT * FROM oldp WHERE filename NOT IN (SELECT filename FROM newp) UNION ALL SELECT * FROM newp)
    SELECT filename, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words FROM res""",
    "delete_document": _CK + """,
    req AS (SELECT filename FROM tox UNION SELECT filename || '.txt' FROM tox)
    SELECT r.filename, CAST(coalesce((SELECT count(*) FROM pts p WHERE p.filename = r.filename), 0) AS BIGINT) AS deleted FROM req r""",
    "delete_state": _CK + """
    SELECT point_id, filename, CAST(chunk_index AS BIGINT) AS chunk_index FROM pts WHERE filename NOT IN (SELECT filename FROM tox)""",
    "clear_collection": _CK + """
    SELECT 'clear' AS step, 'documents' AS collection, CAST(64 AS BIGINT) AS dim, 'Cosine' AS distance, CAST(0 AS BIGINT) AS points,
           '{"deleted":"' || CAST(count(*) AS VARCHAR) || '","success":"true"}' AS report FROM pts""",
    "dim_guard_sides": _MIXED + """
    SELECT point_id, filename, CASE WHEN len(vec) = 64 THEN 'accepted' ELSE 'rejected' END AS side, CAST(len(vec) AS BIGINT) AS dim FROM mixed""",
    "reindex_vectors": _CK + """,
    e AS (""" + hash_embed_sql("pts", "point_id", "text", 64) + """)
    SELECT point_id, filename, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim_index, round(unnest(vec), 6) AS value FROM e JOIN pts USING (point_id)""",
    "dim_guard": _MIXED + """
    SELECT filename, CAST(count(*) AS BIGINT) AS requested_chunks,
           CASE WHEN bool_or(len(vec) <> 64) THEN 'embedding_dim_mismatch' ELSE 'indexed' END AS status FROM mixed GROUP BY filename""",
    "reindex_split": _MIXED + """,
    fixed AS (""" + hash_embed_sql("(SELECT * FROM mixed WHERE len(vec) <> 64)", "point_id", "text", 64) + """),
    res AS (SELECT m.filename, len(m.vec) <> 64 AS reembedded, coalesce(f.vec, m.vec) AS v FROM mixed m LEFT JOIN fixed f USING (point_id))
    SELECT filename, CAST(count_if(len(v) = 64) AS BIGINT) AS upserted, CAST(count_if(reembedded) AS BIGINT) AS reembedded,
           CAST(count_if(len(v) <> 64) AS BIGINT) AS failed, round(sum(v[1]), 6) AS v0_sum FROM res GROUP BY filename""",
    "ingest_report": _CK + """
    SELECT filename, CAST(count(*) AS BIGINT) AS requested_chunks, CAST(count_if(chunk_index % 5 <> 3) AS BIGINT) AS embedded_chunks, CAST(count_if(chunk_index % 5 = 3) AS BIGINT) AS failed_chunks
    FROM pts GROUP BY filename""",
}
