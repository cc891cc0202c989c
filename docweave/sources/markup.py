"""Hyperlinks of markup, by a scan over its tags.

The scan takes attribute values in double, single or no quotes, tags inside a
link's text, character references, comments and upper-case names. It runs in
Arrow batches beside the rows; nothing is shuffled.

Defined results: a null or empty text has no links; a link without text or
without an address is left out; the next link's opening tag ends a link that is still open,
as does the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from docweave.functions.text import fill

LINKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("url", T.StringType())]))
# fixed values: the links of a paged document
SIDE_HEADER = "\n\n**Links from PDF document:**\n"
SIDE_LINE = "- Link (side {n}): {url}\n"
_TYPE = pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []
        self.url: str | None = None
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.end_link()
            self.url = next((v for n, v in attrs if n == "href"), None)

    def handle_endtag(self, tag):
        if tag == "a":
            self.end_link()

    def handle_data(self, data):
        if self.url is not None:
            self.inside.append(data)

    def end_link(self):
        text = "".join(self.inside).strip()
        if self.url and text:
            self.found.append({"text": text, "url": self.url})
        self.url, self.inside = None, []


def scan_links(html: str | None) -> list[dict[str, str]]:
    """The links of one text, in order."""
    scanner = _Links()
    scanner.feed(html or "")
    scanner.close()
    scanner.end_link()
    return scanner.found


@arrow_udf(LINKS)
def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([scan_links(t) for t in batch.to_pylist()], _TYPE)


def markup_links(html) -> Column:
    """``array<struct<text, url>>`` of the links that have both a text and an address."""
    return _scan(F.col(html) if isinstance(html, str) else html)


def side_links(sides: DataFrame, key: str, side: str, links: str = "links") -> DataFrame:
    """``key, links_section``: the links of a paged document, a line each, by page number and place on the page.

    Pages are numbered by ``side``; the section of a document without links is empty.
    """
    line = lambda p: fill(SIDE_LINE, n=F.col(side).cast("string"), url=p["url"])
    page = F.struct(F.col(side).alias("n"), F.array_join(F.transform(links, line), "").alias("lines"))
    ordered = sides.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.size(links) > 0, page))).alias("pages"))
    body = F.array_join(F.transform("pages", lambda p: p["lines"]), "")
    return ordered.select(key, F.when(F.size("pages") > 0, F.concat(F.lit(SIDE_HEADER), body)).otherwise(F.lit("")).alias("links_section"))
