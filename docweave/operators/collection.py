"""Point collections as partitioned Parquet.

State changes are DataFrame transformations (anti / semi joins and unions on
keys). ``Collection`` stores points partitioned by ``type`` and by a hash bucket
of the file name, so the P1 file-type filter prunes directories, an insert only
appends, and a replace or delete rewrites the buckets of the files it names and
no others. Incoming points are staged once in the shared scratch folder, so
vectors are computed once; what is new is found by keys, and texts and vectors
are not shuffled for it. A rewrite adds its files, then removes the old ones, so
nothing is overwritten while it is being read. One writer at a time, and no
reader while it writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import config as C
from docweave.session import scratch_path

POINT_COLUMNS = ["point_id", "filename", "chunk_index", "text", "uploaded_at", "type", "vector"]


# ----------------------------------------------------------------------------- state transitions

def append_points(existing: DataFrame, incoming: DataFrame, key: str = "point_id") -> DataFrame:
    """Insert; content-derived ids make a repeated insert a no-op."""
    new = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new)


def replace_documents(existing: DataFrame, incoming: DataFrame, key: str = "filename", keys: DataFrame | None = None) -> DataFrame:
    """Documents present in ``incoming`` have all their points replaced.

    ``keys`` (the replaced document names) may be given when they are cheaper to
    get than from ``incoming`` itself, so ``incoming`` is computed once.
    """
    ks = (keys if keys is not None else incoming).select(key).distinct()
    keep = existing.join(ks, key, "left_anti")
    return keep.unionByName(incoming)


def _doc_key(df: DataFrame) -> F.Column:
    """Points may carry ``filename`` or ``file_name``; both identify the document."""
    return F.coalesce(F.col("filename"), F.col("file_name")) if "file_name" in df.columns else F.col("filename")


def delete_documents(existing: DataFrame, deletes: DataFrame) -> DataFrame:
    """Drop every point whose filename is listed in ``deletes(filename)``."""
    d = deletes.select(F.col("filename").alias("__del")).distinct()
    e = existing.withColumn("__key", _doc_key(existing))
    return e.join(d, e["__key"] == d["__del"], "left_anti").drop("__key")


def delete_report(existing: DataFrame, deletes: DataFrame) -> DataFrame:
    """Points deleted per requested filename; 0 for unknown names."""
    counts = existing.select(_doc_key(existing).alias("filename")).groupBy("filename").agg(F.count(F.lit(1)).alias("deleted"))
    req = deletes.select("filename").distinct()
    return req.join(counts, "filename", "left").select("filename", F.coalesce("deleted", F.lit(0)).cast("bigint").alias("deleted"))


def clear_report(existing: DataFrame) -> DataFrame:
    """U4: ``success, deleted`` for clearing the whole collection."""
    return existing.agg(F.lit(True).alias("success"), F.count(F.lit(1)).alias("deleted"))


def dim_guard(points: DataFrame, dim: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` by vector length against the collection dimension."""
    ok = F.coalesce(F.size(vector) == F.lit(dim), F.lit(False))
    return points.where(ok), points.where(~ok)


def upload_status(points: DataFrame, dim: int, doc: str = "filename", vector: str = "vector") -> DataFrame:
    """U7 per upload: the reference rejects a whole upload whose embeddings do not fit the collection."""
    g = points.groupBy(doc).agg(
        F.count(F.lit(1)).alias("requested_chunks"),
        F.bool_or(~F.coalesce(F.size(vector) == F.lit(dim), F.lit(False))).alias("__bad"),  # missing vectors fail too
    )
    return g.select(doc, "requested_chunks", F.when(F.col("__bad"), F.lit(C.STATUS_DIM_MISMATCH)).otherwise(F.lit(C.STATUS_INDEXED)).alias("status"))


def reindex(points: DataFrame, dim: int, embed, text: str = "text", vector: str = "vector") -> DataFrame:
    """Re-embed only the points whose vector is missing or of the wrong length.

    One pass: ``embed(df, text_col, out_col)`` runs on a text column that is
    null for points that are already fine, so they cost nothing and the input
    is read once. Rows still wrong afterwards keep ``reindex_ok = false`` (the
    reference counts them as failed).
    """
    bad = ~F.coalesce(F.size(vector) == F.lit(dim), F.lit(False))
    staged = points.withColumn("reembedded", bad).withColumn("__t", F.when(F.col("reembedded"), F.col(text)))
    fixed = embed(staged, "__t", "__v")
    out = fixed.withColumn(vector, F.when(F.col("reembedded"), F.col("__v")).otherwise(F.col(vector))).drop("__t", "__v")
    return out.withColumn("reindex_ok", F.coalesce(F.size(vector) == F.lit(dim), F.lit(False)))


def ingest_report(points: DataFrame, doc: str = "filename", vector: str = "vector") -> DataFrame:
    """U8: requested / embedded / failed chunks per uploaded document."""
    return points.groupBy(doc).agg(
        F.count(F.lit(1)).alias("requested_chunks"),
        F.count_if(F.col(vector).isNotNull()).alias("embedded_chunks"),
        F.count_if(F.col(vector).isNull()).alias("failed_chunks"),
    )


def list_documents(points: DataFrame) -> DataFrame:
    """A1: per filename - chunk count, first upload time and type (deterministic: the minimum)."""
    return points.withColumn("filename", F.coalesce(_doc_key(points), F.lit("unknown"))).groupBy("filename").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("uploaded_at").alias("uploaded_at"), F.min(F.coalesce("type", F.lit("FILE"))).alias("type"))


def rebuild_documents(points: DataFrame) -> DataFrame:
    """A2 / O1: document text = its chunks in ``chunk_index`` order joined by newline (overlap kept)."""
    g = points.groupBy("filename").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("__c"), F.count(F.lit(1)).alias("chunks"))
    return g.select("filename", F.array_join(F.transform("__c", lambda c: c["text"]), "\n").alias("text"), "chunks")


def lookup_documents(points: DataFrame, keys: DataFrame) -> DataFrame:
    """The points of the requested documents (semi join on filename)."""
    return points.join(keys.select("filename").distinct(), "filename", "left_semi")


def scroll(points: DataFrame, limit: int, after: str | None = None, key: str = "point_id") -> DataFrame:
    """S12 paging: the next ``limit`` points after ``after`` in key order (keyset, no offsets)."""
    p = points if after is None else points.where(F.col(key) > F.lit(after))
    return p.orderBy(key).limit(limit)


def point_count(points: DataFrame) -> DataFrame:
    """A11."""
    return points.agg(F.count(F.lit(1)).alias("points"))


# ----------------------------------------------------------------------------- storage

class Collection:
    """A named point collection under ``root`` (any Hadoop-compatible shared path).

    Layout: ``root/points/type=<T>/bucket=<n>/part-*.parquet`` and ``root/meta``, one
    JSON row ``collection, dim, distance, buckets``.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "documents"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name

    @property
    def path(self) -> str:
        return f"{self.root}/points"

    # -- metadata
    def meta(self) -> dict | None:
        """What ``create`` stored, or None without a collection."""
        try:
            stored = self.spark.read.schema("collection string, dim int, distance string, buckets int").json(f"{self.root}/meta")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        rows = stored.collect()  # one row
        return rows[0].asDict() if rows else None

    def _known(self) -> dict:
        m = self.meta()
        if m is None:
            raise FileNotFoundError(f"collection {self.name} not found under {self.root}")
        return m

    def create(self, dim: int, mode: str = "new", confirm: bool = False, distance: str = C.DISTANCE, buckets: int = 16) -> dict:
        """``new`` fails if the collection exists; ``recreate`` needs ``confirm``."""
        if mode not in ("new", "recreate"):
            raise ValueError(f"unknown mode {mode!r}: use new or recreate")
        if mode == "recreate" and not confirm:
            raise ValueError("recreating drops every stored point; pass confirm=True")
        if mode == "new" and self.meta() is not None:
            raise FileExistsError(f"collection {self.name} exists")
        self._empty()
        row = json.dumps({"collection": self.name, "dim": dim, "distance": distance, "buckets": buckets})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/meta")
        return {"status": "recreated" if mode == "recreate" else "created", "collection": self.name, "size": dim}

    @staticmethod
    def schema(dim: int):
        from pyspark.sql import types as T

        return T.StructType([
            T.StructField("point_id", T.StringType()), T.StructField("filename", T.StringType()),
            T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()),
            T.StructField("uploaded_at", T.TimestampNTZType()), T.StructField("type", T.StringType()),
            T.StructField("vector", T.ArrayType(T.DoubleType())),
        ])

    # -- files
    def _delete(self, path) -> None:
        """``path``: a string, or a URI as ``_metadata.file_path`` gives it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _empty(self) -> None:
        self._delete(self.path)
        self.spark.createDataFrame([], self.schema(0).add("bucket", "integer")).write.partitionBy("type", "bucket").parquet(self.path)

    def _bucketed(self, points: DataFrame) -> DataFrame:
        return points.select(*POINT_COLUMNS).withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("filename", F.lit(""))), F.lit(self._known()["buckets"])).cast("int"))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema(0).add("bucket", "integer")).parquet(self.path)

    def _staged(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"staged-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _in(self, touched: DataFrame, *more) -> DataFrame:
        """The stored points in the partitions ``touched`` (type, bucket), at most buckets x types rows."""
        at, stored = F.broadcast(touched.select(F.col("type").alias("__type"), F.col("bucket").alias("__bucket"))), self._stored().select("*", *more)
        return stored.join(at, stored["type"].eqNullSafe(at["__type"]) & stored["bucket"].eqNullSafe(at["__bucket"]), "left_semi")

    def _rewrite(self, touched: DataFrame, rows: DataFrame) -> None:
        """Replace the partitions in ``touched`` (type, bucket) by ``rows``, all of which lie in them.

        The rows are written as new files beside the old ones, which they may be read from; then the old files go.
        """
        old = self._in(touched, F.col("_metadata.file_path").alias("file")).select("file").distinct().collect()  # file names, from the layout
        rows.select(*POINT_COLUMNS, "bucket").write.mode("append").partitionBy("type", "bucket").parquet(self.path)
        for r in old:
            self._delete(self.spark._jvm.java.net.URI(r["file"]))

    # -- data
    def read(self) -> DataFrame:
        """All points (no page caps, D3)."""
        self._known()
        return self._stored().drop("bucket")

    def _fitting(self, points: DataFrame) -> tuple[DataFrame, int]:
        """The points, computed once, and how many do not fit the collection."""
        staged = self._staged(self._bucketed(points).withColumn("__row", F.monotonically_increasing_id()))
        return staged, dim_guard(staged, self._known()["dim"])[1].count()

    def upsert(self, points: DataFrame) -> dict:
        """U1 + U7: reject a batch whose vectors do not fit, else append what is not stored yet."""
        staged, n_bad = self._fitting(points)
        if n_bad:
            return {"error": C.STATUS_DIM_MISMATCH, "rejected": n_bad}
        key = ["type", "bucket", "point_id"]
        first = staged.groupBy(key).agg(F.min("__row").alias("__row"))  # keys are shuffled, texts and vectors are not
        new = self._staged(first.join(self._stored().select(key), key, "left_anti").select("__row"))
        n_staged, n_new = staged.count(), new.count()
        if n_new == 0:
            return {"status": C.STATUS_INDEXED, "inserted": 0}
        rows = staged
        if n_new < n_staged:  # by the shorter list of rows
            few = 2 * n_new <= n_staged
            listed = new if few else self._staged(staged.select("__row").join(new, "__row", "left_anti"))
            rows = staged.join(listed, "__row", "left_semi" if few else "left_anti")
        rows.select(*POINT_COLUMNS, "bucket").write.mode("append").partitionBy("type", "bucket").parquet(self.path)
        return {"status": C.STATUS_INDEXED, "inserted": n_new}

    def replace(self, points: DataFrame) -> dict:
        """U2 + U7: the files in ``points`` have all their points replaced."""
        staged, n_bad = self._fitting(points)
        if n_bad:
            return {"error": C.STATUS_DIM_MISMATCH, "rejected": n_bad}
        names = staged.select("type", "bucket", "filename").distinct()
        touched = names.select("type", "bucket").distinct()
        kept = self._in(touched).join(self._staged(names), ["type", "bucket", "filename"], "left_anti")
        columns = [*POINT_COLUMNS, "bucket"]
        self._rewrite(touched, kept.select(columns).unionByName(staged.select(columns)))
        return {"status": C.STATUS_INDEXED, "inserted": staged.count()}

    def reindex(self, embed) -> dict:
        """Points whose vector does not fit the dimension are embedded anew, in the buckets that hold such points."""
        dim = self._known()["dim"]
        bad = self._stored().where(~F.coalesce(F.size("vector") == dim, F.lit(False)))
        touched = self._staged(bad.select("type", "bucket").distinct())
        done = reindex(self._in(touched), dim, embed)
        staged = self._staged(done)
        self._rewrite(touched, staged.where("reindex_ok"))
        r = staged.agg(F.count_if("reembedded").alias("n"), F.count_if(~F.col("reindex_ok")).alias("failed")).first()
        return {"reembedded": r["n"], "failed": r["failed"]}

    def delete(self, filenames: DataFrame) -> int:
        """Returns the number of deleted points."""
        names = self._staged(filenames.select("filename").distinct())  # a table of known size
        hit = self._staged(self._stored().join(names, "filename", "left_semi").select("type", "bucket", "filename"))
        n = hit.count()
        if n:
            touched = hit.select("type", "bucket").distinct()
            self._rewrite(touched, self._in(touched).join(names, "filename", "left_anti"))
        return n

    def clear(self) -> dict:
        """U4."""
        n = self.read().count()
        self._empty()
        return {"success": True, "deleted": n}
