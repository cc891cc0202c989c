"""Registered queries: sources and parsers.

The file-based ones first write files derived from the driver's tables into a
fresh folder under the shared checkpoint directory, then read them back through
the real sources, so the whole round trip is checked against the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators.arrays import posexplode_kept
from docweave.operators.embed import embed
from docweave.session import scratch_path
from docweave.sources import files as FS
from docweave.sources import markup as MU
from docweave.sources.csv_records import csv_file_rows
from docweave.sources.tables import table
from docweave.sources.vectors import coerce_status, coerce_vectors, load_vectors

EXT_BY_LANG = {"en": "txt", "fr": "md", "de": "pdf", "es": "bin"}


def _fresh(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


def _ext(lang):
    e = F.lit("bin")
    for k, v in reversed(list(EXT_BY_LANG.items())):
        e = F.when(lang == k, F.lit(v)).otherwise(e)
    return e


def linearize_rows(spark, sf):
    """S6 on any table: ``col: val`` for non-null cells joined by `` | ``."""
    p = table(spark, sf, "part")
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ": "), F.col(c).cast("string"))) for c in p.columns]
    return p.select("p_partkey", F.concat_ws(" | ", *cells).alias("line"))


def read_files(spark, sf):
    """S1 + S3 + S4 + S11: documents written as files (extension from the language), read back, dispatched."""
    out = _fresh(spark, "files")
    d = table(spark, sf, "documents")
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), _ext(F.col("lang")))
    FS.write_text_files(d, name, "text", out)
    f = FS.read_files(spark, out).withColumn("filename", FS.written_name("path"))
    return FS.parse_uploads(f).select("filename", "format", "parse_status", "text")


def csv_ingest(spark, sf):
    """S1 + S5 + S6: the part table written as ';'-separated CSV files (one folder per brand), parsed back."""
    out = _fresh(spark, "csv")
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    p.write.partitionBy("p_brand").option("header", True).option("sep", ";").csv(out)
    f = FS.read_files(spark, out, glob="*.csv")
    f = f.select(F.col("path").alias("filename"), FS.decode_utf8("content").alias("text"))
    lines = FS.linearize_csv(f, "filename", "text")
    return lines.select(F.url_decode(F.regexp_extract("filename", r"p_brand=([^/]+)/", 1)).alias("brand"), "line")


def csv_large_file(spark, sf):
    """S1 + S5 + S6: all order lines in one CSV file, above one partition's size, with line breaks, quotes and separators in cells."""
    out = _fresh(spark, "csv-large")
    note = F.when(F.pmod("l_partkey", F.lit(4)) == 0, F.concat(F.lit('part "'), F.col("l_partkey").cast("string"), F.lit('";\nsupplier\n\n'), F.col("l_suppkey").cast("string"), F.lit(", end")))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line no"), note.alias("note"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").cast("date").alias("shipped"))
    rows.coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').csv(out)  # one file, as one upload would be
    return csv_file_rows(spark, out).select("line", "fallback")


#: CSV texts of a part, by p_partkey mod 5: quoted, indexed, too long (falls back), labelled, with missing cells.
_CSV_SHAPES = ['name,price\n"@n, ""x""",@p\n', "name,price\n7,@n,@p\n8,@n\n", "name,price\n@n,@p\n\n1,2,3", "Sheet: One\nname;price\n@n;@p\n", "name,price,\nNA,@p,\n@n,null,z\n"]


def csv_documents(spark, sf):
    """A CSV upload for each part, as its parsed text."""
    p = table(spark, sf, "part")
    shape = F.element_at(F.array(*map(F.lit, _CSV_SHAPES)), (F.pmod("p_partkey", F.lit(len(_CSV_SHAPES))) + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("@n"), F.col("p_name")), F.lit("@p"), F.col("p_size").cast("string"))
    name = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".csv"))
    return p.select("p_partkey", FS.csv_text(name, text).alias("text"))


def url_shortcut(spark, sf):
    """An Internet-shortcut file per page; some lead to report or share sites, some nowhere."""
    p = table(spark, sf, "pages")
    fn = F.concat(F.lit("Page_Link_"), F.col("page_id").cast("string"), F.lit(".url"))
    site = F.pmod("page_id", F.lit(10))
    url = (F.when(site == 0, F.concat(F.lit("https://app.powerbi.com/r/"), F.col("page_id").cast("string")))
           .when(site == 1, F.concat(F.lit("https://x.sharepoint.com/s/"), F.col("page_id").cast("string"))).otherwise(F.col("url")))
    line = F.when(site == 2, F.lit("")).otherwise(F.concat(F.lit("URL="), url))
    content = F.concat(F.lit("[InternetShortcut]\r\n"), line, F.lit("\r\nIconIndex=0\r\n"))
    return p.select("page_id", FS.parse_url_shortcut(fn, content).alias("text"))


def extract_links(spark, sf):
    """Hyperlinks of each page and the links section appended after a document body."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.size(FS.links("html")).cast("bigint").alias("n_links"), FS.links_section("html").alias("links_section"))


def markup_links(spark, sf):
    """Every link of every page, found by a scan over the tags."""
    p = table(spark, sf, "pages").select("page_id", MU.markup_links("html").alias("links"))
    out = posexplode_kept(p, ["page_id"], "links", "link_no", "l")
    return out.select("page_id", F.col("link_no").cast("bigint"), F.col("l.text").alias("text"), F.col("l.url").alias("url"))


def side_links(spark, sf):
    """S9, paged form: the pages of a host are the sides of one document, numbered by page_id."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    sides = table(spark, sf, "pages").select(host, "page_id", MU.markup_links("html").alias("links"))
    return MU.side_links(sides, "host", "page_id")


def flatten_parts(spark, sf):
    """Conversation turns as the ordered parts of a document."""
    return FS.flatten_parts(table(spark, sf, "conversations"), "conv_id", "turn", "text")


def format_dispatch(spark, sf):
    """S3 + S11 on upload names."""
    d = table(spark, sf, "documents")
    fn = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), F.upper(_ext(F.col("lang"))))
    fmt = FS.file_format(fn)
    return d.select("doc_id", fn.alias("filename"), fmt.alias("format"),
                    F.when(fmt.isin("text", "csv", "url"), F.lit("ok")).otherwise(F.lit("unsupported")).alias("parse_status"),
                    F.when(~fmt.isin("text", "csv", "url"), FS.placeholder(fn, fmt)).alias("placeholder"))


def read_json_text(spark, sf):
    """JSON uploads ``{doc_id, text, filename?}`` (no filename for Spanish documents)."""
    out = _fresh(spark, "json")
    d = table(spark, sf, "documents")
    name = F.when(F.col("lang") != "es", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    d.select("doc_id", "text", name.alias("filename")).write.json(out)
    from pyspark.sql import types as T
    schema = T.StructType([*FS.JSON_UPLOAD_SCHEMA.fields, T.StructField("doc_id", T.LongType())])
    ok, _rej = FS.read_json_uploads(spark, out, schema)
    return ok.select("doc_id", F.when(F.col("generated_name"), F.lit("<generated>")).otherwise(F.col("filename")).alias("filename"),
                     "generated_name", F.length("text").cast("bigint").alias("n_chars"))


def json_upload_sides(spark, sf):
    """Both sides of JSON uploads, where French documents arrive without their text."""
    out = _fresh(spark, "json-sides")
    d = table(spark, sf, "documents")
    d.select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text"), F.col("source").alias("filename")).write.json(out)
    from pyspark.sql import types as T
    sides = FS.read_json_uploads(spark, out, T.StructType([*FS.JSON_UPLOAD_SCHEMA.fields, T.StructField("doc_id", T.LongType())]))
    ok, rejects = (x.select("doc_id", "filename", F.lit(side).alias("side"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
                   for x, side in zip(sides, ("accepted", "rejected"), strict=True))
    return ok.unionByName(rejects)


def _payload_shapes(spark, sf):
    """One payload per vector, in ten shapes by id; the last three are errors."""
    e = table(spark, sf, "embeddings")
    v = F.to_json(F.col("embedding").cast("array<double>"))  # exact decimal form of each float
    shapes = ['{"embeddings": [@]}', '{"vectors": [@, @]}', '{"data": [{"embedding": @}, {"x": 1}, {"vector": @}]}', '{"embedding": @}', "@",
              '{"embeddings": @}', '{"embedding": [@, @]}', '{"data": [{"embeddings": [@]}]}', '{"nothing": @}', '["a", @']
    payload = F.element_at(F.array(*[F.replace(F.lit(s), F.lit("@"), v) for s in shapes]), (F.pmod("vec_id", F.lit(len(shapes))) + 1).cast("int"))
    return e.select("vec_id", payload.alias("payload"))


def coerce_embedding_payload(spark, sf):
    """Every vector of every payload shape, and an error row for what fits none."""
    p = _payload_shapes(spark, sf).select("vec_id", coerce_status("payload").alias("status"), coerce_vectors("payload").alias("vs"))
    n = F.coalesce(F.size("vs"), F.lit(0)).cast("bigint")
    total = F.aggregate(F.flatten("vs"), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", "status", n.alias("n_vectors"), F.when(n > 0, F.size(F.element_at("vs", -1))).otherwise(0).cast("bigint").alias("dim"), F.round(total, 4).alias("total"))


def _vector_uploads(spark, sf):
    """One upload document per vector; label-0 vectors arrive without their vector."""
    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    j = e.join(d, "vec_id", "left")
    chunk = F.struct(F.coalesce("text", F.lit("")).alias("text"),
                     F.when(F.col("label") != 0, F.col("embedding")).alias("vector"), F.lit(0).alias("chunk_index"))
    doc = F.struct(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("vec_"), F.col("vec_id").cast("string"), F.lit(".json")).alias("filename"),
                   F.array(chunk).alias("chunks"))
    return j.select(F.to_json(F.struct(doc.alias("document"))).alias("payload"))


def load_vectors_report(spark, sf):
    """What became of each uploaded document."""
    _chunks, report = load_vectors(_vector_uploads(spark, sf))
    return report.select("id", "status", "reason", F.col("upserted").cast("bigint"))


def load_vector_chunks(spark, sf):
    """The chunks taken up, with every place of their vectors."""
    chunks, _report = load_vectors(_vector_uploads(spark, sf))
    out = posexplode_kept(chunks.withColumn("n_chars", F.length("text")), ["id", "filename", "chunk_index", "n_chars"], "vector", "dim_index", "value")
    return out.select("id", "filename", *(F.col(c).cast("bigint").alias(c) for c in ("chunk_index", "n_chars", "dim_index")),
                      F.col("value").cast("float").cast("double").alias("value"))


def batch_embed_provider(spark, sf):
    """K1: the default provider chain on a machine without a neural model falls back to the hash embedding."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = embed(d, "text", "vec", provider="sentence")
    x = posexplode_kept(e, ["doc_id"], "vec", "dim_index", "value")
    return x.select("doc_id", F.col("dim_index").cast("bigint"), F.round("value", 6).alias("value"))


QUERIES = {
    "linearize_rows": linearize_rows,
    "read_files": read_files,
    "csv_ingest": csv_ingest,
    "csv_documents": csv_documents,
    "csv_large_file": csv_large_file,
    "url_shortcut": url_shortcut,
    "extract_links": extract_links,
    "markup_links": markup_links,
    "side_links": side_links,
    "flatten_parts": flatten_parts,
    "format_dispatch": format_dispatch,
    "read_json_text": read_json_text,
    "coerce_embedding_payload": coerce_embedding_payload,
    "load_vectors": load_vectors_report,
    "load_vector_chunks": load_vector_chunks,
    "json_upload_sides": json_upload_sides,
    "batch_embed_provider": batch_embed_provider,
}

_EXT = "CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'pdf' ELSE 'bin' END"
_NAME = "replace(name0, '_', ' ')"
_CELL = "CASE WHEN {c} IS NOT NULL THEN '{c}: ' || CAST({c} AS VARCHAR) END"
_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_CSV_COLS = ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"]
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _concat_ws(cols):
    return "concat_ws(' | ', " + ", ".join(_CELL.format(c=c) for c in cols) + ")"


_ANCH = '<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'

_LINK_ROWS = f"""l AS (SELECT page_id, k, {_STRIP.format(x="regexp_replace(t, '<[^>]*>', '', 'g')")} AS text, u AS url FROM (
            SELECT page_id, unnest(regexp_extract_all(html, '{_ANCH}', 2)) AS t, unnest(regexp_extract_all(html, '{_ANCH}', 1)) AS u,
                   generate_subscripts(regexp_extract_all(html, '{_ANCH}', 1), 1) AS k FROM pages))"""

ORACLE = {
    "linearize_rows": f"SELECT p_partkey, {_concat_ws(_PART_COLS)} AS line FROM part",
    "read_files": f"""
        SELECT source || '_' || CAST(doc_id AS VARCHAR) || '.' || {_EXT} AS filename,
               CASE {_EXT} WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'pdf' THEN 'pdf' ELSE 'other' END AS format,
               CASE WHEN {_EXT} IN ('txt', 'md') THEN 'ok' ELSE 'unsupported' END AS parse_status,
               CASE WHEN {_EXT} IN ('txt', 'md') THEN text || chr(10)
                    WHEN {_EXT} = 'pdf' THEN '[Simulated PDF parsing for ' || source || '_' || CAST(doc_id AS VARCHAR) || '.pdf - pdf parsing libraries missing or failed]'
                    ELSE '[Simulated parsing for ' || source || '_' || CAST(doc_id AS VARCHAR) || '.bin - demo mode]' || chr(10) || 'Content not extracted.' END AS text
        FROM documents""",
    "csv_documents": """
        WITH c AS (SELECT p_partkey, p_name AS n, CAST(p_size AS VARCHAR) AS p, '**Data from part_' || CAST(p_partkey AS VARCHAR) || '.csv**' || chr(10) || chr(10) AS h FROM part)
        SELECT p_partkey, CASE p_partkey % 5
            WHEN 0 THEN h || 'name: ' || n || ', "x" | price: ' || p || chr(10)
            WHEN 1 THEN h || 'name: ' || n || ' | price: ' || p || chr(10) || 'name: ' || n || chr(10)
            WHEN 2 THEN 'name, price' || chr(10) || n || ', ' || p || chr(10) || chr(10) || '1, 2, 3'
            WHEN 3 THEN h || 'name: ' || n || ' | price: ' || p || chr(10)
            ELSE h || 'price: ' || p || chr(10) || 'name: ' || n || ' | Unnamed: 2: z' || chr(10) END AS text FROM c""",
    "csv_large_file": """
        SELECT concat_ws(' | ', 'order: ' || l_orderkey, 'line no: ' || l_linenumber,
                         CASE WHEN l_partkey % 4 = 0 THEN 'note: part "' || l_partkey || '";' || chr(10) || 'supplier' || chr(10) || chr(10) || l_suppkey || ', end' END,
                         'status: ' || l_linestatus, 'shipped: ' || CAST(l_shipdate AS DATE)) AS line, false AS fallback FROM lineitem""",
    "csv_ingest": f"SELECT p_brand AS brand, {_concat_ws(_CSV_COLS)} AS line FROM part",
    "url_shortcut": f"""
        WITH w AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'https://app.powerbi.com/r/' || CAST(page_id AS VARCHAR)
                          WHEN 1 THEN 'https://x.sharepoint.com/s/' || CAST(page_id AS VARCHAR) WHEN 2 THEN '' ELSE url END AS url FROM pages),
        u AS (SELECT page_id, url, 'Page Link ' || CAST(page_id AS VARCHAR) AS name,
                          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS d0 FROM w),
        v AS (SELECT *, CASE WHEN d0 = '' THEN 'Unknown domain' ELSE d0 END AS dom FROM u)
        SELECT page_id, CASE WHEN coalesce(url, '') <> '' THEN
            '**' || name || '**' || chr(10) || chr(10) || 'Type: Internet Link / Shortcut' || chr(10) || 'Description: This is a link to ' || name || '.' || chr(10)
            || CASE WHEN contains(dom, 'powerbi.com') THEN 'This is a Power BI report link.' || chr(10) WHEN contains(dom, 'sharepoint.com') THEN 'This is a SharePoint link.' || chr(10) ELSE '' END
            || chr(10) || 'Link: [' || name || '](' || url || ')' || chr(10) || chr(10) || 'Keywords: ' || name || ', link, shortcut, URL' || chr(10)
          ELSE 'Internet shortcut: Page_Link_' || CAST(page_id AS VARCHAR) || '.url' END AS text
        FROM v""",
    "extract_links": f"""
        WITH l AS (SELECT page_id, regexp_extract_all(html, '{_ANCH}', 1) AS urls, regexp_extract_all(html, '{_ANCH}', 2) AS texts FROM pages),
        z AS (SELECT page_id, list_filter(list_zip(list_transform(texts, lambda t: {_STRIP.format(x='t')}), urls), lambda p: p[1] <> '' AND p[2] <> '') AS ps FROM l)
        SELECT page_id, CAST(len(ps) AS BIGINT) AS n_links,
               CASE WHEN len(ps) > 0 THEN chr(10) || chr(10) || '**Links from document:**' || chr(10)
                    || array_to_string(list_transform(ps, lambda p: '- ' || p[1] || ': ' || p[2]), chr(10)) ELSE '' END AS links_section
        FROM z""",
    "markup_links": f"""
        WITH {_LINK_ROWS}
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS link_no, text, url FROM l WHERE text <> '' AND url <> ''""",
    "side_links": f"""
        WITH {_LINK_ROWS},
        s AS (SELECT regexp_extract(p.url, '^https?://([^/]+)', 1) AS host,
                     string_agg('- Link (side ' || CAST(page_id AS VARCHAR) || '): ' || l.url || chr(10), '' ORDER BY page_id, k) FILTER (WHERE l.text <> '' AND l.url <> '') AS body
              FROM pages p LEFT JOIN l USING (page_id) GROUP BY 1)
        SELECT host, CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || '**Links from PDF document:**' || chr(10) || body END AS links_section FROM s""",
    "flatten_parts": f"""
        SELECT conv_id,
               coalesce(string_agg({_STRIP.format(x='text')}, chr(10) ORDER BY turn) FILTER (WHERE {_STRIP.format(x='text')} <> ''), '') AS docx_text,
               string_agg(chr(10) || '--- Slide ' || CAST(rn AS VARCHAR) || ' ---' || chr(10) || CASE WHEN coalesce(text, '') <> '' THEN text || chr(10) ELSE '' END, '' ORDER BY turn) AS pptx_text
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id""",
    "format_dispatch": f"""
        SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || '.' || upper({_EXT}) AS filename,
               CASE {_EXT} WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'pdf' THEN 'pdf' ELSE 'other' END AS format,
               CASE WHEN {_EXT} IN ('txt', 'md') THEN 'ok' ELSE 'unsupported' END AS parse_status,
               CASE WHEN {_EXT} = 'pdf' THEN '[Simulated PDF parsing for ' || source || '_' || CAST(doc_id AS VARCHAR) || '.PDF - pdf parsing libraries missing or failed]'
                    WHEN {_EXT} = 'bin' THEN '[Simulated parsing for ' || source || '_' || CAST(doc_id AS VARCHAR) || '.BIN - demo mode]' || chr(10) || 'Content not extracted.' END AS placeholder
        FROM documents""",
    "read_json_text": """
        SELECT doc_id, CASE WHEN lang = 'es' THEN '<generated>' ELSE source || '_' || CAST(doc_id AS VARCHAR) || '.txt' END AS filename,
               lang = 'es' AS generated_name, CAST(length(text) AS BIGINT) AS n_chars FROM documents""",
    "coerce_embedding_payload": """
        WITH s AS (SELECT vec_id, list_sum(CAST(embedding AS DOUBLE[])) AS t, len(embedding) AS d,
                          CASE WHEN vec_id % 10 IN (1, 2, 6) THEN 2 WHEN vec_id % 10 < 7 THEN 1 ELSE 0 END AS n FROM embeddings)
        SELECT vec_id, CASE WHEN n > 0 THEN 'ok' ELSE 'error' END AS status, CAST(n AS BIGINT) AS n_vectors,
               CAST(CASE WHEN n > 0 THEN d ELSE 0 END AS BIGINT) AS dim, CASE WHEN n > 0 THEN round(n * t, 4) END AS total FROM s""",
    "json_upload_sides": """
        SELECT doc_id, source AS filename, CASE WHEN lang = 'fr' OR text IS NULL THEN 'rejected' ELSE 'accepted' END AS side,
               CAST(CASE WHEN lang <> 'fr' THEN coalesce(length(text), 0) ELSE 0 END AS BIGINT) AS n_chars FROM documents""",
    "load_vector_chunks": """
        WITH v AS (SELECT vec_id, coalesce(length(text), 0) AS n, embedding FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE label <> 0)
        SELECT CAST(vec_id AS VARCHAR) AS id, 'vec_' || CAST(vec_id AS VARCHAR) || '.json' AS filename, CAST(0 AS BIGINT) AS chunk_index,
               CAST(n AS BIGINT) AS n_chars, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim_index,
               CAST(unnest(embedding) AS DOUBLE) AS value FROM v""",
    "load_vectors": """
        SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label = 0 THEN 'skipped' ELSE 'upserted' END AS status,
               CASE WHEN label = 0 THEN 'missing vector for chunk 0' END AS reason, CAST(CASE WHEN label = 0 THEN 0 ELSE 1 END AS BIGINT) AS upserted
        FROM embeddings""",
}


def _late():
    from docweave.plans.sql_blocks import hash_embed_sql
    ORACLE["batch_embed_provider"] = "WITH e AS (" + hash_embed_sql("documents", "doc_id", "text", 64) + """)
            SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim_index, round(unnest(vec), 6) AS value FROM e"""


_late()
