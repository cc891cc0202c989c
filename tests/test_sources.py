from pyspark.sql import functions as F

from conftest import one
from docweave.sources import files as FS
from docweave.sources.vectors import coerce_status, coerce_vectors, load_vectors


def lines_of(spark, text, name="f.csv"):
    df = spark.createDataFrame([(name, text)], "filename string, text string")
    return [r.line for r in FS.linearize_csv(df).orderBy("row_no").collect()]


def test_csv_semicolon_and_comma(spark):
    assert lines_of(spark, "a;b\n1;2\n3;") == ["a: 1 | b: 2", "a: 3"]
    assert lines_of(spark, "a,b\n1,2") == ["a: 1 | b: 2"]


def test_csv_sheet_label_and_prose(spark):
    assert lines_of(spark, "Sheet: One, Two\nSome prose here\nx;y\n5;6\n\n7;8") == ["x: 5 | y: 6", "x: 7 | y: 8"]


def test_csv_no_separator_and_fallback(spark):
    assert lines_of(spark, "title\nvalue") == ["title: value"]
    assert lines_of(spark, "a,b\n1,2,3") == ["a: 2 | b: 3"]  # the leading cell is an index
    assert lines_of(spark, "a,b\n1,2\n1,2,3") == ["a, b", "1, 2", "1, 2, 3"]
    assert lines_of(spark, "") == [] and lines_of(spark, "a,b") == []


def test_csv_quotes_missing_cells_and_names(spark):
    assert lines_of(spark, 'a,b\n"x, y",2\n"say ""hi""",NA\n,null') == ["a: x, y | b: 2", 'a: say "hi"', ""]
    assert lines_of(spark, "a,,a\n1,2,3\n4") == ["a: 1 | Unnamed: 1: 2 | a.1: 3", "a: 4"]
    assert lines_of(spark, "a,b\n1,2,3\n4,5") == ["a: 2 | b: 3", "a: 5"]
    df = spark.createDataFrame([("f.csv", bytearray(b"a;b\n1;2\n")), ("g.csv", bytearray(b"a,b\n1,2\n1,2,3\n"))], "filename string, content binary")
    got = {r.filename: r.text for r in FS.parse_uploads(df).collect()}
    assert got == {"f.csv": "**Data from f.csv**\n\na: 1 | b: 2\n", "g.csv": "a, b\n1, 2\n1, 2, 3"}


def shortcut(spark, name, body):
    df = spark.createDataFrame([(name, body)], "n string, b string")
    return df.select(FS.parse_url_shortcut(F.col("n"), F.col("b"))).first()[0]


def test_url_shortcut(spark):
    t = shortcut(spark, "Sales_Report.url", "[InternetShortcut]\nURL=https://app.powerbi.com/r/1\n")
    assert t.startswith("**Sales Report**\n\nType: Internet Link / Shortcut\n")
    assert "This is a Power BI report link.\n" in t and "Link: [Sales Report](https://app.powerbi.com/r/1)" in t
    assert "This is a SharePoint link." in shortcut(spark, "a.url", "url=https://x.sharepoint.com:443/s")
    assert shortcut(spark, "none.url", "[InternetShortcut]\nIconIndex=0") == "Internet shortcut: none.url"
    assert "Keywords: a, link, shortcut, URL\n" in shortcut(spark, "a.url", "  URL=http://h:8080/p")


def test_dispatch_and_decode(spark):
    df = spark.createDataFrame([("a.TXT", bytearray(b"hi\xff")), ("b.docx", bytearray(b"x")), ("c.zip", bytearray(b"x"))],
                               "filename string, content binary")
    got = {r.filename: (r.format, r.parse_status, r.text) for r in FS.parse_uploads(df).collect()}
    assert got["a.TXT"] == ("text", "ok", "hi�")
    assert got["b.docx"][1] == "unsupported" and got["b.docx"][2].startswith("[Simulated DOCX parsing for b.docx")
    assert got["c.zip"][2] == "[Simulated parsing for c.zip - demo mode]\nContent not extracted."


def test_links(spark):
    html = '<a href="/x">X</a> <a href="/y"> </a> <a class="k" href="">Z</a>'
    assert one(spark, FS.links_section(F.col("t")), html) == "\n\n**Links from document:**\n- X: /x"


def test_payload_shapes(spark):
    one_v, two_v = [[1.0, 2.0]], [[1.0, 2.0], [3.0, 4.0]]
    shapes = {'{"embeddings": [[1, 2]]}': one_v, '{"vectors": [[1, 2], [3, 4]]}': two_v, '{"data": [{"vector": [1, 2]}]}': one_v,
              '{"embedding": [1, 2]}': one_v, "[1, 2]": one_v, "[[1, 2]]": one_v, '{"embeddings": [1, 2]}': one_v, '{"vectors": [1, 2]}': one_v,
              '{"embedding": [[1, 2], [3, 4]]}': two_v, '{"embeddings": null, "vectors": [1, 2]}': one_v, "[]": [],
              '{"data": [{"embedding": [1, 2], "vector": [9]}, {"x": 1}, {"embeddings": [3, 4]}]}': two_v,
              '{"nothing": 1}': None, '{"data": [{"embeddings": [[1, 2]]}]}': None, '{"data": []}': None, "[1, [2]]": None, "nonsense": None, '["a"]': None}
    for text, want in shapes.items():
        assert one(spark, coerce_vectors(F.col("t")), text) == want, text
        assert one(spark, coerce_status(F.col("t")), text) == ("error" if want is None else "ok"), text
    assert one(spark, coerce_vectors(F.col("t")), None) is None


def test_payloads_without_a_document_are_reported(spark):
    raw = ['{"documents": [], "document": {"id": "d", "chunks": [{"text": "t", "vector": [1]}]}}', "not json", '{"documents": []}', None, '{"document": {"id": "e", "chunks": []}}']
    chunks, report = load_vectors(spark.createDataFrame([(r,) for r in raw], "payload string"))
    assert sorted((r.status, r.reason or "", r.upserted) for r in report.collect()) == [
        ("skipped", "no chunks provided", 0), *[("skipped", "no document in payload", 0)] * 3, ("upserted", "", 1)]
    assert [(r.id, r.vector) for r in chunks.collect()] == [("d", [1.0])]


def test_load_vectors(spark):
    from docweave.sources.vectors import load_vectors

    payloads = [
        '{"documents": [{"id": "a", "filename": "a.pdf", "chunks": [{"text": "t0", "vector": [1, 0]}, {"text": "t1", "embed": [0, 1], "chunk_index": 7}]},'
        ' {"id": "b", "chunks": []}, {"id": "c", "chunks": [{"text": "x", "vector": []}]}]}',
        '{"document": {"chunks": [{"text": "solo", "vector": [0.5, 0.5]}]}}',
    ]
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    chunks, report = load_vectors(df)
    rep = {r.id: (r.status, r.reason, r.upserted) for r in report.collect()}
    assert rep["a"] == ("upserted", None, 2)
    assert rep["b"] == ("skipped", "no chunks provided", 0)
    assert rep["c"] == ("skipped", "missing vector for chunk 0", 0)
    assert len(rep) == 4  # the anonymous document gets a content-derived id
    got = sorted((r.id, r.chunk_index, r.vector) for r in chunks.where("id = 'a'").collect())
    assert got == [("a", 0, [1.0, 0.0]), ("a", 7, [0.0, 1.0])]
    assert chunks.where("text = 'solo'").first().filename.startswith("upload-")
    demo_chunks, demo_rep = load_vectors(df, demo=True, dim=8)
    assert {r.id: r.status for r in demo_rep.collect()}["c"] == "upserted"
    assert len(demo_chunks.where("id = 'c'").first().vector) == 8


def test_files_of_a_task_share_a_folder_and_keep_their_names_and_lines(spark, tmp_path):
    rows = [("a_1.txt", "x\ny"), ("a_1.txt", "z"), ("b:2%.md", ""), (None, "w"), ("c_3.txt", None)]
    df = spark.createDataFrame(rows, "name string, text string").coalesce(1)
    df.write.partitionBy("name").text(f"{tmp_path}/plain")
    FS.write_text_files(df, F.col("name"), "text", f"{tmp_path}/flat")
    want = FS.read_files(spark, f"{tmp_path}/plain").select(F.regexp_extract("path", "name=([^/]+)/", 1), "content").collect()
    got = FS.read_files(spark, f"{tmp_path}/flat").select(FS.written_name("path"), "content").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len(list(tmp_path.glob("flat/*"))) == 1  # one folder to list, not one a file


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    for name in ("top.csv", "a/x y.txt", "a/b%20c.csv", "a/é.gz", "a/_k=1.csv", "a/b/c/deep.CSV", "a/_x.csv", "_h/z.csv", ".q/z.csv", "a/e.csv._COPYING_", "_metadata_x/q.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "a/empty.csv").write_bytes(b"")
    (tmp_path / "nothing").mkdir()
    for glob in (None, "*.csv", "{top,x}*", "[^a-b]*.csv"):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        want = (plain.option("pathGlobFilter", glob) if glob else plain).load(str(tmp_path)).select("path", "content")
        got = FS.read_files(spark, str(tmp_path), glob)
        assert sorted(map(tuple, got.select("path", "content").collect())) == sorted(map(tuple, want.collect())) != []
        assert not any(f.endswith((".csv", ".txt")) for f in got.inputFiles())  # the driver holds no index of the files
    assert FS.read_files(spark, f"{tmp_path}/nothing").count() == 0
    assert FS.read_files(spark, f"{tmp_path}/top.csv").count() == 1 and FS.read_files(spark, f"{tmp_path}/a/*.csv").count() == 2


def test_large_files_leave_a_task_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FS, "BATCH_BYTES", 10)
    for i in range(9):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (4 * i))
    assert sorted((r.filename, len(r.content)) for r in FS.read_files(spark, str(tmp_path)).collect()) == [(f"{i}.bin", 4 * i) for i in range(1, 9)]


def test_json_queries_leave_the_shared_schema_alone(spark, tmp_path):
    from docweave.plans import ingest_queries as Q

    rows = [(1, "a", "en", "s", 1), (2, "b", "es", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("json_upload_sides", "read_json_text", "read_json_text"):
        Q.QUERIES[name](spark, str(tmp_path))
    assert FS.JSON_UPLOAD_SCHEMA.fieldNames() == ["text", "filename"]
