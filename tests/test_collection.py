import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docweave.operators.collection import Collection, append_points, delete_report


def pts(spark, ids, dim=4):
    rows = [(f"id{i}", f"f{i % 3}.pdf", i, f"text {i}", dt.datetime(2024, 1, 1), "PDF", [0.5] * dim) for i in ids]
    return spark.createDataFrame(rows, Collection.schema(dim))


def test_append_is_idempotent(spark):
    a = pts(spark, range(5))
    once = append_points(a, pts(spark, range(3, 8)))
    twice = append_points(once, pts(spark, range(3, 8)))
    assert once.count() == twice.count() == 8


def test_delete_report_unknown_is_zero(spark):
    d = spark.createDataFrame([("f0.pdf",), ("nope.pdf",)], "filename string")
    got = {r.filename: r.deleted for r in delete_report(pts(spark, range(9)), d).collect()}
    assert got == {"f0.pdf": 3, "nope.pdf": 0}


def test_collection_lifecycle(spark):
    root = tempfile.mkdtemp(prefix="dw-coll-")
    c = Collection(spark, os.path.join(root, "c"))
    assert c.create(4)["status"] == "created"
    with pytest.raises(FileExistsError):
        c.create(4)
    with pytest.raises(ValueError):
        c.create(4, mode="recreate")
    assert c.upsert(pts(spark, range(6)))["status"] == "indexed"
    assert c.upsert(pts(spark, range(6)))["status"] == "indexed"
    assert c.read().count() == 6
    assert c.upsert(pts(spark, range(2), dim=3))["error"] == "embedding_dim_mismatch"
    assert c.delete(spark.createDataFrame([("f1.pdf",)], "filename string")) == 2
    assert c.read().count() == 4
    assert c.read().where(F.col("type") == "PDF").count() == 4
    assert c.clear() == {"success": True, "deleted": 4}
    assert c.read().count() == 0


def test_scroll_pages_cover_everything(spark):
    from docweave.operators.collection import scroll

    p = pts(spark, range(23))
    seen, after = [], None
    while True:
        page = [r.point_id for r in scroll(p, 5, after).collect()]
        if not page:
            break
        seen += page
        after = page[-1]
    assert seen == sorted(f"id{i}" for i in range(23))


def test_upload_status_and_reindex_with_missing_vectors(spark):
    from pyspark.sql import functions as F

    from docweave.functions.vectors import with_hash_embedding
    from docweave.operators.collection import reindex, upload_status

    p = pts(spark, range(4)).withColumn("vector", F.when(F.col("chunk_index") == 1, F.lit(None)).otherwise(F.col("vector")))
    st = {r.filename: r.status for r in upload_status(p, 4).collect()}
    assert st == {"f0.pdf": "indexed", "f1.pdf": "embedding_dim_mismatch", "f2.pdf": "indexed"}
    r = reindex(p, 4, lambda df, t, o: with_hash_embedding(df, t, o, 4)).orderBy("chunk_index").collect()
    assert [x.reembedded for x in r] == [False, True, False, False]
    assert all(x.reindex_ok for x in r) and len(r[1].vector) == 4


def test_replace_and_reindex_touch_only_their_buckets(spark, tmp_path):
    from pathlib import Path

    from docweave.functions.vectors import with_hash_embedding

    c = Collection(spark, f"{tmp_path}/c")
    c.create(4, buckets=8)
    c.upsert(pts(spark, range(30)))
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(f"{tmp_path}/c/points").rglob("part-*.parquet")}
    before = files()
    new = pts(spark, [1]).withColumn("text", F.lit("new")).withColumn("point_id", F.lit("n1"))
    assert c.replace(new) == {"status": "indexed", "inserted": 1}
    got = {r.point_id: r.text for r in c.read().collect()}
    assert len(got) == 21 and got["n1"] == "new" and "id1" not in got and "id0" in got
    kept = {p for p in before if p in files()}
    assert kept and len(kept) < len(before)
    assert c.replace(pts(spark, [2], dim=3))["rejected"] == 1
    other = Collection(spark, f"{tmp_path}/d")
    other.create(3)
    other.upsert(pts(spark, range(6), dim=3))
    other._known = lambda: {"dim": 4, "buckets": 16}  # the collection moves to another dimension
    assert other.reindex(lambda df, t, o: with_hash_embedding(df, t, o, 4)) == {"reembedded": 6, "failed": 0}
    assert {len(r.vector) for r in other.read().collect()} == {4}
    assert c.create(5, mode="recreate", confirm=True)["status"] == "recreated"
    assert c.read().count() == 0 and c.meta()["dim"] == 5


def test_an_unreadable_place_is_an_error(spark):
    with pytest.raises(Exception):  # noqa: B017 - whatever the file system raises
        Collection(spark, "nosuchscheme://x/c").meta()


def test_an_insert_shuffles_keys_and_writes_its_points_twice_at_most(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c")
    c.create(4, buckets=4)
    staged, plans = c._staged, []
    c._staged = lambda df: (plans.append(df.columns), staged(df))[1]
    assert c.upsert(pts(spark, range(20)).unionByName(pts(spark, range(5)))) == {"status": "indexed", "inserted": 20}
    assert c.upsert(pts(spark, range(18, 30)))["inserted"] == 10
    assert c.upsert(pts(spark, range(30)))["inserted"] == 0
    assert sorted(r.point_id for r in c.read().collect()) == sorted(f"id{i}" for i in range(30))
    assert sum("vector" in p for p in plans) == 3  # one staged copy an insert, and lists of row numbers
    assert all(p == ["__row"] for p in plans if "vector" not in p)
