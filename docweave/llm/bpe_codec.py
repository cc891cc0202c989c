"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until its parts are short, each part is encoded by itself, and
neighbours are joined on the way up: the pieces at the seam are encoded anew,
the others stand because a piece only ends where a space lies between two
non-space characters, which the seam cannot change. Inside one match of the
pattern the same is done on tokens (``RankBPE.join``). Decoding concatenates the
bytes of pieces up the same tree.

Defined results: a null text counts as empty (0 tokens, digests of nothing);
repeated rows each give a row; a null id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.bpe import RankBPE, pieces, split
from docweave.llm.common import Memo, arrow_batch, id_and_text, slices

LEAF_CHARS = 4096


class TextCodec:
    """Encodes and decodes whole texts; ``piece`` holds the ids of pieces seen before, as text."""

    def __init__(self, bpe: RankBPE):
        self.bpe = bpe
        self.piece = Memo(self._piece)
        self.by_name = {str(i): t for t, i in bpe.ranks.items()}

    def _piece(self, text: str) -> str:
        encode = self.bpe.encode
        return " ".join([str(i) for match in split(text) for i in encode(match.encode())])

    def parts(self, text: str, leaf: int = LEAF_CHARS) -> list[str]:
        """The pieces of a text, found by halves."""
        if len(text) <= leaf:
            return pieces(text)
        mid = len(text) // 2
        left, right = self.parts(text[:mid], leaf), self.parts(text[mid:], leaf)
        # The seam may cut a piece, or hide that a space next to it starts one: widen the window by a
        # piece on each side until its outer pieces come back unchanged.
        i = j = 1
        while True:
            window = pieces("".join([*left[-i:], *right[:j]]))
            stable_left = i >= len(left) or window[0] == left[-i]
            stable_right = j >= len(right) or window[-1] == right[j - 1]
            if stable_left and stable_right or i > len(left) and j > len(right):
                return left[:-i] + window + right[j:]
            i, j = (i if stable_left else i + 1), (j if stable_right else j + 1)

    def ids_text(self, text: str) -> str:
        return " ".join(map(self.piece.__getitem__, self.parts(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.ids_text(text).split()))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the bytes decoded from the ids."""
        ids = self.ids_text(text)
        names = ids.split()
        back = b"".join(map(self.by_name.__getitem__, names))
        return len(names), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> TextCodec:
    """One codec for each Python worker, so that pieces seen once are not merged again."""
    return TextCodec(RankBPE.load(path))


def encode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids.

    No shuffle; each task works through its own rows.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*map(c.digest, texts), strict=True)
            yield arrow_batch(schema, [batch.column(0), n, ids, back, *([[c.encode(t) for t in texts]] if with_ids else [])])

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(df, id_col, text_col).mapInArrow(run, ddl)


def decode_documents(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes that an array of token ids stands for; null ids give empty bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = RankBPE.load(ranks_path)
        for batch in batches:
            yield arrow_batch(schema, [batch.column(0), [tree_decode(bpe, ids or []) for ids in batch.column(1).to_pylist()]])

    from pyspark.sql import functions as F

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def tree_decode(bpe: RankBPE, ids: list[int], leaf: int = 4096) -> bytes:
    if len(ids) <= leaf:
        return bpe.decode(ids)
    mid = len(ids) // 2
    return tree_decode(bpe, ids[:mid], leaf) + tree_decode(bpe, ids[mid:], leaf)
