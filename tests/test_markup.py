from pyspark.sql import functions as F

from docweave.sources.markup import markup_links, scan_links, side_links

CASES = {
    '<a href="/x">X</a> <a href="/y"> </a> <a class="k" href="">Z</a>': [("X", "/x")],
    "<A HREF='/s?a=1&amp;b=2' title=\"a > b\">S &amp; T</A>": [("S & T", "/s?a=1&b=2")],
    "<a href=/u>un<b>quo</b>ted</a>": [("unquoted", "/u")],
    "<a href='/1'>one<a href='/2'>two": [("one", "/1"), ("two", "/2")],
    "<!-- <a href='/no'>no</a> --><p>text</p></a><a name=n>n</a>": [],
    "<a\n href = \"/n\"\n>a\nb</a>": [("a\nb", "/n")],
    "": [],
}


def test_hand_cases_and_nulls(spark):
    df = spark.createDataFrame([(h, want) for h, want in CASES.items()] + [(None, [])], "html string, want array<struct<text: string, url: string>>")
    for r in df.withColumn("got", markup_links("html")).collect():
        assert r["got"] == r["want"], r["html"]


def test_long_text_is_scanned_whole():
    assert len(scan_links("<a href='/x'>x</a> " * 50_000)) == 50_000


def test_side_form(spark):
    rows = [(1, 2, "<a href='/b'>b</a>"), (1, 1, "<a href='/a'>a</a><a href=/c>c</a>"), (2, 1, None)]
    df = spark.createDataFrame(rows, "doc long, side int, html string").withColumn("links", markup_links("html"))
    got = {r["doc"]: r["links_section"] for r in side_links(df, "doc", "side").collect()}
    assert got == {1: "\n\n**Links from PDF document:**\n- Link (side 1): /a\n- Link (side 1): /c\n- Link (side 2): /b\n", 2: ""}
    assert side_links(df.where(F.lit(False)), "doc", "side").count() == 0
