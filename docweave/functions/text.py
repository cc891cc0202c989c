"""Text Column functions (whitespace, sentences, names, snippets, query checks).

All are built-in Spark expressions, so they run inside whole-stage codegen or
as JVM higher-order functions; nothing here calls back into Python.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave import config as C

# Python's ``str.split()`` / ``\s`` whitespace: Unicode White_Space plus the
# four information separators 0x1C-0x1F, which Java's ``(?U)\s`` lacks.
WS_CLASS = r"[\s\x1c-\x1f]"
WS_RUN = r"(?U)[\s\x1c-\x1f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, **cols) -> Column:
    """A fixed text template with ``{name}`` slots filled by Columns (one ``concat``)."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else cols[p] for i, p in enumerate(parts)])


def normalize_ws(c) -> Column:
    """every whitespace run becomes one space, then trim."""
    return F.trim(F.regexp_replace(_col(c), WS_RUN, " "))


def py_strip(c) -> Column:
    """Strip leading and trailing (Unicode) whitespace, like ``str.strip()``."""
    return F.regexp_replace(_col(c), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def py_rstrip(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)[\s\x1c-\x1f]+\z", "")


def is_blank(c) -> Column:
    """True for null, empty or whitespace-only text."""
    c = _col(c)
    return c.isNull() | c.rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def split_sentences(normalized) -> Column:
    """split normalised text after ``.``, ``!`` or ``?`` followed by whitespace.

    Empty text gives an empty array (the chunker emits no chunk for it).
    """
    t = _col(normalized)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?<=[.!?])\s+"))


def word_count(c) -> Column:
    """Number of whitespace-separated words (``len(s.split())``)."""
    c = _col(c)
    n = normalize_ws(c)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ")))


def file_type(filename, default: str = "TXT") -> Column:
    """Upper-cased last ``.``-part; ``default`` when there is no dot.

    The upload and reindex paths default to ``TXT``, the vector adapter to ``FILE``.
    """
    fn = _col(filename)
    return F.when(fn.contains("."), F.upper(F.substring_index(fn, ".", -1))).otherwise(F.lit(default))


def snippet(text, n: int = C.SNIPPET_CHARS) -> Column:
    """First ``n`` characters, plus ``...`` when the text is longer."""
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def title_of(name) -> Column:
    """Drop ``.pdf`` / ``.docx`` anywhere (case-sensitive), ``_`` -> space; default ``Document``."""
    t = F.coalesce(_col(name), F.lit("Document"))
    t = F.replace(t, F.lit(".pdf"), F.lit(""))
    t = F.replace(t, F.lit(".docx"), F.lit(""))
    return F.replace(t, F.lit("_"), F.lit(" "))


def title_prefixed(title, text, window: int = C.TITLE_PREFIX_WINDOW) -> Column:
    """``**title**\\n\\n`` + text unless the title already opens the text."""
    ti, tx = _col(title), _col(text)
    head = F.lower(F.substring(tx, 1, window))
    needs = (F.length(ti) > 0) & ~F.contains(head, F.lower(ti))
    return F.when(needs, F.concat(F.lit("**"), ti, F.lit("**\n\n"), tx)).otherwise(tx)


def expand_query(query) -> Column:
    """F8: normalise whitespace, then append the extras of every dictionary term
    found (substring) in the lower-cased original, in dictionary order."""
    q = normalize_ws(query)
    low = F.lower(q)
    parts = [q] + [F.when(low.contains(term), F.lit(" " + extra)).otherwise(F.lit("")) for term, extra in C.SYNONYMS]
    return F.concat(*parts)


def _contains_any(low: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(t) for t in terms])


def is_math(text) -> Column:
    """arithmetic-only text with an operator, or a math word plus a digit."""
    t = _col(text)
    clean = py_strip(F.replace(t, F.lit(" "), F.lit("")))
    arith = clean.rlike(r"(?U)^[\d+\-*/()=.,\s]*[+\-*/][\d+\-*/()=.,\s]*$")
    word = _contains_any(F.lower(t), C.MATH_WORDS) & t.rlike(r"(?U)\d")
    return F.when(t.isNull() | (t == ""), F.lit(False)).otherwise(arith | word)


def classify_domain(text) -> Column:
    """struct(domain, is_it); first matching rule wins."""
    t = _col(text)
    low = F.lower(t)
    domain = (
        F.when(is_blank(t), F.lit("unknown"))
        .when(is_math(t), F.lit("math"))
        .when(_contains_any(low, C.NON_IT_TERMS), F.lit("non_it"))
        .when(_contains_any(low, C.IT_TERMS), F.lit("it"))
        .otherwise(F.lit("unknown"))
    )
    is_it = F.when(is_blank(t), F.lit(False)).otherwise(domain.isin("it", "unknown"))
    return F.struct(domain.alias("domain"), is_it.alias("is_it"))


def validate_query(query, max_chars: int = C.MAX_QUERY_CHARS) -> Column:
    """struct(is_valid, message)."""
    q = _col(query)
    msg = (
        F.when(is_blank(q), F.lit(C.EMPTY_QUERY_MESSAGE))
        .when(F.length(q) > max_chars, F.lit(C.LONG_QUERY_MESSAGE))
        .when(classify_domain(q)["domain"] == "non_it", F.lit(C.NON_IT_MESSAGE))
    )
    return F.struct(msg.isNull().alias("is_valid"), msg.alias("message"))
