"""Pre-computed vector payloads."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave import config as C
from docweave.functions.text import fill
from docweave.functions.vectors import with_hash_embedding
from docweave.operators.arrays import explode_kept, posexplode_kept

VEC = T.ArrayType(T.DoubleType())
#: Each field as its JSON text, so that its depth decides how it is read.
PAYLOAD_SCHEMA = "embeddings string, vectors string, data string, embedding string"


def _numbers(j: Column) -> Column:
    """A flat JSON list of numbers, null if it is anything else."""
    v = F.from_json(j, VEC)
    return F.when(j.rlike(r"^\s*\[") & F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False)), v)


def _vectors(j: Column) -> Column:
    """``array<array<double>>`` of a JSON list: a flat list of numbers is one vector; null if it does not fit."""
    rows = F.transform(F.from_json(j, "array<string>"), _numbers)
    return (F.when(j.rlike(r"^\s*\[\s*\]"), F.array().cast(T.ArrayType(VEC)))
            .when(j.rlike(r"^\s*\[\s*\["), F.when(F.forall(rows, lambda r: r.isNotNull()), rows))
            .otherwise(F.when(_numbers(j).isNotNull(), F.array(_numbers(j)))))


def coerce_vectors(payload_json) -> Column:
    """``array<array<double>>`` from any accepted payload shape; null when none fits (an error in the service).

    Shapes, in precedence order: ``{embeddings}``, ``{vectors}``,
    ``{data: [{embedding | embeddings | vector}]}``, ``{embedding}``, a bare list;
    each list holds numbers (one vector) or lists of numbers.
    """
    j = F.col(payload_json) if isinstance(payload_json, str) else payload_json
    obj = F.from_json(j, PAYLOAD_SCHEMA)
    is_list = lambda c: F.coalesce(c.startswith("["), F.lit(False))
    items = F.transform(F.from_json(obj["data"], "array<string>"), lambda x: F.from_json(x, "map<string,string>"))
    key = lambda m: F.when(F.map_contains_key(m, "embedding"), m["embedding"]).when(F.map_contains_key(m, "embeddings"), m["embeddings"]).when(F.map_contains_key(m, "vector"), m["vector"])
    named = F.transform(F.filter(items, lambda m: F.coalesce(F.exists(F.map_keys(m), lambda k: k.isin("embedding", "embeddings", "vector")), F.lit(False))), lambda m: _numbers(key(m)))
    data = F.when((F.size(named) > 0) & F.forall(named, lambda v: v.isNotNull()), named)
    from_obj = (F.when(is_list(obj["embeddings"]), _vectors(obj["embeddings"])).when(is_list(obj["vectors"]), _vectors(obj["vectors"]))
                .when(is_list(obj["data"]), data).when(is_list(obj["embedding"]), _vectors(obj["embedding"])))
    return F.when(F.ltrim(j).startswith("{"), from_obj).otherwise(_vectors(F.ltrim(j)))


def coerce_status(payload_json) -> Column:
    """``ok``, or ``error`` for a payload that S14 accepts in no shape."""
    return F.when(coerce_vectors(payload_json).isNotNull(), "ok").otherwise("error")


REASON_NO_DOCUMENT = "no document in payload"
UPLOAD_CHUNK = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("vector", VEC), T.StructField("embed", VEC),
    T.StructField("chunk_index", T.IntegerType()),
])
UPLOAD_DOC = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("chunks", T.ArrayType(UPLOAD_CHUNK)),
])
UPLOAD_SCHEMA = T.StructType([T.StructField("documents", T.ArrayType(UPLOAD_DOC)), T.StructField("document", UPLOAD_DOC)])


def load_vectors(payloads: DataFrame, payload_col: str = "payload", demo: bool = False, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(chunks, report)`` from vector-upload payloads.

    ``chunks``: ``id, filename, chunk_index, text, vector`` of accepted documents;
    ``report``: ``id, status, reason, upserted``, with a row for a payload that holds no document or cannot be read. A document with no chunks is
    skipped; one chunk without a vector skips the whole document unless ``demo``,
    where such chunks are hash-embedded instead.
    """
    p = payloads.select(F.col(payload_col).alias("raw"), F.from_json(payload_col, UPLOAD_SCHEMA).alias("p"))
    given = F.coalesce(F.when(F.size("p.documents") > 0, F.col("p.documents")), F.when(F.col("p.document").isNotNull(), F.array("p.document")))
    none = p.where(given.isNull()).select(
        F.sha2(F.coalesce("raw", F.lit("")), 256).alias("id"), F.lit(C.STATUS_SKIPPED).alias("status"), F.lit(REASON_NO_DOCUMENT).alias("reason"), F.lit(0).alias("upserted"))
    docs = explode_kept(p, [], given, "d")
    # defaults: a content-derived id (idempotent, D2), and a name that holds it, so unnamed uploads stay apart
    unnamed = F.sha2(F.to_json("d"), 256)
    docs = docs.select(
        F.coalesce(F.col("d.id"), unnamed).alias("id"),
        F.coalesce(F.col("d.filename"), F.concat(F.lit(f"upload-{int(time.time())}-"), F.substring(unnamed, 1, 16))).alias("filename"),
        F.coalesce("d.chunks", F.array().cast(T.ArrayType(UPLOAD_CHUNK))).alias("chunks"))
    vec = lambda c: F.coalesce(F.when(F.size(c["vector"]) > 0, c["vector"]), F.when(F.size(c["embed"]) > 0, c["embed"]))
    missing = F.transform("chunks", lambda c, i: F.when(vec(c).isNull(), i))
    first_missing = F.array_min(F.filter(missing, lambda x: x.isNotNull()))
    docs = docs.withColumn("__miss", first_missing)
    status = (F.when(F.size("chunks") == 0, F.lit(C.STATUS_SKIPPED))
              .when(F.col("__miss").isNotNull() & F.lit(not demo), F.lit(C.STATUS_SKIPPED)).otherwise(F.lit(C.STATUS_UPSERTED)))
    reason = (F.when(F.size("chunks") == 0, F.lit(C.REASON_NO_CHUNKS))
              .when(F.col("__miss").isNotNull() & F.lit(not demo), fill(C.REASON_MISSING_VECTOR, i=F.col("__miss").cast("string"))))
    report = docs.select("id", status.alias("status"), reason.alias("reason"),
                         F.when(status == C.STATUS_UPSERTED, F.size("chunks")).otherwise(F.lit(0)).alias("upserted")).unionByName(none)
    ok = posexplode_kept(docs.where(status == C.STATUS_UPSERTED), ["id", "filename"], "chunks", "pos", "c")
    chunks = ok.select("id", "filename", F.coalesce(F.col("c.chunk_index"), F.col("pos")).alias("chunk_index"),
                       F.coalesce(F.col("c.text"), F.lit("")).alias("text"), vec(F.col("c")).alias("vector"))
    if demo:
        have, need = chunks.where(F.col("vector").isNotNull()), chunks.where(F.col("vector").isNull())
        chunks = have.unionByName(with_hash_embedding(need.drop("vector"), "text", "vector", dim).select(*have.columns))
    return chunks, report
