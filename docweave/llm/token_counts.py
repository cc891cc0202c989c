"""Exact token counts at every prefix of a text.

Inside one match of the pattern, the last token of every prefix follows from a
dynamic program (``RankBPE.prefixes``), and with it the number of tokens. The
counts are stored as the change from one prefix to the next, one signed byte a
character (four bytes where a change does not fit), so a budget or truncation
question is a running sum and needs no encoding.

A prefix is counted as the library would count it standing alone. Where the end
of the prefix changes the split of what stands before it (a run of white space
that a later character would have divided, half a contraction, half a special
string), the count follows the prefix, not the full text.

Defined results: a null text counts as empty (0 bytes, 0 tokens, no steps);
repeated rows each give a row; a null id stays null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import RankBPE, pieces, split
from docweave.llm.common import arrow_batch, id_and_text, slices

_RUN = regex.compile(r"\s{2,}")
_PARTIAL = {"'re", "'ve", "'ll"}


class PrefixCounter:
    def __init__(self, bpe: RankBPE, specials: tuple[str, ...] = (), limit: int = 1_000_000):
        self.bpe = bpe
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.specials = specials
        self.limit = limit
        self.piece: dict[str, bytes | np.ndarray] = {}

    def _tables(self, matches: set[str]) -> dict[str, list[int]]:
        """Tokens of every prefix, by characters, of each match of the pattern.

        In sorted order a match takes over the states of the prefix it shares with the one before.
        """
        tables = {}
        before, last, count = b"", [-1], [0]
        extend = self.bpe.extend
        for match, data in sorted(((m, m.encode()) for m in matches), key=lambda x: x[1]):
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            extend(data, last, count)
            before = data
            tables[match] = count[1:] if len(data) == len(match) else [count[e] for e in accumulate(len(c.encode()) for c in match)]
        return tables

    def learn(self, found: set[str]) -> None:
        """Work out the steps of the pieces that are not known yet."""
        if len(self.piece) + len(found) > self.limit:
            self.piece.clear()
        new = {p: split(p) for p in found if p not in self.piece}
        runs = {p: _RUN.findall(p) for p in new if not p[-1:].isalpha() or "\n" in p}
        tables = self._tables({m for ms in new.values() for m in ms} | {r for rs in runs.values() for r in rs})
        for p, matches in new.items():
            if len(matches) == 1 and matches[0] not in _PARTIAL:
                counts = tables[matches[0]]
            else:
                counts = self._counts(p, matches, tables)
            try:
                self.piece[p] = bytes([(b - a) & 255 for a, b in zip([0, *counts], counts, strict=False) if -128 <= b - a < 128 or self._wide()])
            except OverflowError:
                self.piece[p] = np.diff(counts, prepend=0).astype(np.int32)

    @staticmethod
    def _wide() -> bool:
        raise OverflowError("a step that needs more than a byte")

    def _counts(self, piece: str, matches: list[str], tables: dict[str, list[int]]) -> list[int]:
        counts: list[int] = []
        base = 0
        for match in matches:
            own = tables[match]
            counts += [base + c for c in own]
            if match in _PARTIAL:  # cut after two characters it is an apostrophe and a letter
                counts[-2] = base + 2
            base += own[-1]
        for run in _RUN.finditer(piece):  # up to its end, a run of white space is one match
            s = run.start()
            start = counts[s - 1] if s else 0
            counts[s : run.end()] = [start + c for c in tables.get(run.group()) or self._tables({run.group()})[run.group()]]
        return counts

    def _plain(self, text: str) -> np.ndarray:
        parts = pieces(text)
        try:
            got = list(map(self.piece.__getitem__, parts))
        except KeyError:
            self.learn(set(parts))
            got = list(map(self.piece.__getitem__, parts))
        try:
            return np.frombuffer(b"".join(got), np.int8)
        except TypeError:  # a step that needs four bytes
            return np.concatenate([np.frombuffer(g, np.int8) if isinstance(g, bytes) else g for g in got]).astype(np.int32)

    def steps(self, text: str) -> np.ndarray:
        """Change of the token count from each prefix to the next; a running sum gives the counts."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            own = self._plain(text[at : m.start()])
            partial = self._plain(text[at : m.end() - 1]).astype(np.int32)
            out += [partial, [int(own.sum(dtype=np.int64)) + 1 - int(partial.sum())]]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:])]).astype(np.int32)

    def total(self, text: str) -> int:
        return int(self.steps(text).sum(dtype=np.int64))


def longest_within(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    ok = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    return PrefixCounter(RankBPE.load(path), tuple(t["content"] for t in added))


def prefix_token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, step_bytes (1 or 4) and steps (binary).

    ``steps`` holds, for each character, the signed change of the token count; see ``truncation``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("step_bytes", pa.int32()), ("steps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            c.learn({p for t in texts for p in pieces(t)})
            steps = [c.steps(t) for t in texts]
            yield arrow_batch(schema, [batch.column(0), [len(t.encode()) for t in texts], [int(s.sum(dtype=np.int64)) for s in steps], [s.itemsize for s in steps], [s.tobytes() for s in steps]])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, step_bytes int, steps binary")


def truncation(counts: DataFrame, budget: int) -> DataFrame:
    """(doc_id, keep_chars): the longest prefix of each document within ``budget`` tokens, from stored steps."""
    schema = pa.schema([("doc_id", pa.int64()), ("keep_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, width, steps = (batch.column(i).to_pylist() for i in range(3))
            yield arrow_batch(schema, [doc, [longest_within(np.frombuffer(s, np.int8 if w == 1 else np.int32), budget) for w, s in zip(width, steps, strict=True)]])

    return counts.select("doc_id", "step_bytes", "steps").mapInArrow(run, "doc_id long, keep_chars long")


def count_tokens(df: DataFrame, vocabulary_path: str, limit: int = 1024, **columns) -> DataFrame:
    """The last entry of each document's prefix table, and whether it is over ``limit``."""
    c = prefix_token_counts(df, vocabulary_path, **columns)
    return c.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
