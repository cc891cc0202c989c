r"""Secrets in texts: fixed patterns, and values in credential contexts that are costly to guess.

The cost of a value is the least sum, over all ways to cut it into segments, of
the decimal logarithms of the guesses each segment takes: a known word (by rank,
with capitals and look-alike digits), a date, a repeat, a walk on the keyboard,
or characters tried one by one. Known words are the usual passwords, then the
words and parts of words of a public tokenizer's vocabulary, most usual first.
Marks that open or close a phrase around a value cost nothing. Values whose cost
reaches a threshold are added as ``guess`` spans; the threshold is higher by
``PROSE`` where only a blank or "is" joins name and value, as prose has that too.
Spans of the fixed patterns are always kept.

Spans are in code points, ends exclusive; they cover the whole match of a fixed
pattern and the value alone for ``guess``. Defined results: a null or empty text
has no spans; repeated rows each give a row; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.common import arrow_batch, id_and_text, slices

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Names before a value that make it a credential.
_CONTEXT_HINTS = (*_ASSIGN_HINTS, b"passphrase", b"passcode", b"pwd", b"credential", b"bearer", b"access_key", b"private_key", b"auth")
_CONTEXT = re.compile(rb"""(?i:password|passwd|passphrase|passcode|pwd|secret|credentials?|token|bearer|api_?key|access_?key|private_?key|auth)(?i:["']?(?:\x20+is)?[\x20\t]*(?P<mark>[:=]+>?)[\x20\t]*["']?|\x20+(?:is\x20+)?["']?)(?=[!-&(-~]{6})""")
_VALUE = re.compile(rb"[!-&(-~]+")
#: What may stand around a value in a phrase.
_OPEN, _CLOSE = b"([{<*`\"", b".,;:!?)]}>*`\""
#: What the cost must reach beyond the threshold where no : or = follows the name.
PROSE = 4.0

# --- fixed values: words tried first, most usual first -----------------------
USUAL = (
    "password 123456 qwerty admin welcome letmein dragon monkey master login abc123 iloveyou sunshine princess "
    "football shadow secret token changeme default guest root user test example hello world love summer winter "
    "spring autumn baseball superman batman trustno1 starwars computer internet service server private public "
    "access system oracle google apple amazon facebook london paris berlin america january february march april "
    "june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "the and you that was for are with his they this have from one had word but not what all were when your can said"
).split()
#: Its vocabulary is in the order of use.
WORDS = "word_bpe_49k.json"
_LONGEST_WORD = 16
_LOOKALIKE = str.maketrans("@4310$57!", "aaeiosstl"[:9])
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {a + b for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    """Known words by rank, loaded once for each Python worker."""
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in sorted(vocabulary, key=vocabulary.__getitem__))
    known = dict.fromkeys([*USUAL, *(w for w in words if w.isascii() and w.isalpha() and 3 <= len(w) <= _LONGEST_WORD)])
    return {w: i + 1 for i, w in enumerate(known)}


def _single(c: str) -> float:
    """Digits tried one by one take 10 guesses each, letters 26 (each case), others 33."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes."""
    n = len(value)
    rank = _ranks()
    low = value.lower()
    plain = low.translate(_LOOKALIKE)
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            dates.setdefault(i, []).append(m.end())
    repeat_to = [0] * n
    walk_to = [0] * n
    for i in range(n - 1, -1, -1):
        same = i + 1 < n and value[i + 1] == value[i]
        repeat_to[i] = repeat_to[i + 1] if same else i + 1
        walk_to[i] = walk_to[i + 1] if i + 1 < n and low[i : i + 2] in _NEXT else i + 1
    for i in range(n):
        here = best[i]
        steps = [(i + 1, _single(value[i]))]
        for j in range(i + 3, min(n, i + _LONGEST_WORD) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                if form in rank:
                    capitals = sum(c.isupper() for c in value[i:j])
                    steps.append((j, math.log10(rank[form]) + 0.5 + extra + min(capitals, j - i - capitals, 4) * 0.7 + (0.3 if capitals else 0)))
                    break
        steps += [(j, math.log10(365 * 120 if j - i > 4 else 120)) for j in dates.get(i, ())]
        if repeat_to[i] - i >= 3:
            steps.append((repeat_to[i], _single(value[i]) + math.log10(repeat_to[i] - i)))
        if walk_to[i] - i >= 3:
            steps.append((walk_to[i], math.log10(47) + 0.5 * math.log10(walk_to[i] - i) * 2))
        for j, cost in steps:
            if here + cost < best[j]:
                best[j] = here + cost
    return best[n]


def _context_values(data: bytes, threshold: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in credential contexts that are costly to guess, without closing marks.

    Every name is looked at, also one that stands where another's value would: the value then is
    that of the later name. A value inside one that is reported is not reported again.
    """
    run = done = 0
    for m in _CONTEXT.finditer(data):
        start = m.end()
        if start < done or _CONTEXT.match(data, start):
            continue
        if start >= run:  # values that start in one run of characters end together
            run = _VALUE.match(data, start).end()
        value = data[start:run]
        if guess_cost(value.lstrip(_OPEN).rstrip(_CLOSE).decode()) >= (threshold if m["mark"] else threshold + PROSE):
            done = start + len(value.rstrip(_CLOSE.translate(None, b"!?*")))
            yield start, done


def find_spans(text: str, threshold: float = 8.0) -> list[tuple[str, int, int]]:
    """(kind, start, end), sorted by start, then kind as listed."""
    data = text.encode()
    low = data.lower()
    found: list[tuple[int, int, int]] = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    if any(h in low for h in _CONTEXT_HINTS):
        found += [(start, 3, end) for start, end in _context_values(data, threshold)]
    if not found:
        return []
    if len(text) != len(data):  # bytes to code points
        ends = sorted({x for s, _, e in found for x in (s, e)})
        point, at, chars = {}, 0, 0
        for e in ends:
            chars += len(data[at:e].decode())
            point[e], at = chars, e
        found = [(point[s], k, point[e]) for s, k, e in found]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def redact(text: str, mark: str = "[REDACTED]", threshold: float = 8.0) -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for _, s, e in find_spans(text, threshold):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_documents(df: DataFrame, threshold: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans as an array of (kind, start, end)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", threshold)] for t in batch.column(1).to_pylist()]
            yield arrow_batch(schema, [batch.column(0), spans])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_documents(df: DataFrame, threshold: float = 8.0, text_col: str = "text") -> DataFrame:
    """``df`` with secrets in ``text_col`` replaced; a null text stays null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(s):
        return s.map(lambda t: t if t is None else redact(t, threshold=threshold))

    return df.withColumn(text_col, clean(F.col(text_col).cast("string")))


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of the fixed patterns' spans, their digest, and all spans as text."""
    from pyspark.sql import functions as F

    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = joined(F.filter("spans", lambda x: x["kind"] != KINDS[3]))
    return spans.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """What ``span_digests`` gives as base_sha256, for one list of spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k != KINDS[3]).encode()).hexdigest()
