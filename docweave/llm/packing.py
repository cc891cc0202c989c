"""Sum-of-squares online packing of tokenised documents into fixed-size sequences.

A document's whole sequences are cut off first; its rest goes, as it arrives, to
the open sequence whose fill level keeps the sum over levels of the squared
number of open sequences at that level smallest, a new sequence being level 0.
The numbers are kept in one array indexed by level. Every task packs its own
rows, so nothing is shuffled; what is still open at a task's end is laid end to
end and cut at the sequence size, so a task pads one sequence at most.

Defined results: a null text counts as empty, so its document is the end id
alone; repeated rows are packed separately; a null id stays null.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docweave.llm.bpe import printable
from docweave.llm.common import arrow_batch, id_and_text, slices

SEQUENCE = 2048
_FAR = np.int64(1) << 60


class WordTokenizer:
    """Ids of whole texts for a vocabulary that drops white space and case.

    No match of its pattern contains white space, so the ids of a text are those
    of its words. Words not known yet are encoded many at once: those of plain
    characters by the ranks of the same vocabulary, a line feed standing for the
    end of a match; all others by the library, with a word between them that is
    one token and stands in none of them.
    """

    BETWEEN = "\x01"
    #: Lower-case words that the normalizer leaves alone, and the vocabulary's pattern for these characters.
    PLAIN = re.compile(r"[!-@\[-~à-öø-ÿß]{1,1000}")
    MATCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        (self.between,) = self._encode(self.BETWEEN)
        byte_of = {c: b for b, c in printable().items()}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        ranks = {}
        for token, rank in model["vocab"].items():
            core = token.removesuffix(suffix)
            ranks[bytes(byte_of[c] for c in core) + b"\n" * (core != token)] = rank
        self.plain = tiktoken.Encoding("words", pat_str=r"[^\n ]+\n| ", mergeable_ranks=ranks, special_tokens={})
        self.space = ranks[b" "]

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    @staticmethod
    def words(text: str) -> list[bytes]:
        if "<|" not in text and max(text, default="") < "\u0100":  # lower case is one to one, and no special string appears
            text = text.lower()
        return text.encode().split()

    def _store(self, words: list[bytes], ids: np.ndarray, between: int) -> None:
        cut = np.flatnonzero(ids == between)
        if len(cut) != len(words) - 1:
            raise ValueError("the word between words stands in one of them")
        data = ids.tobytes()
        begin, end = [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(data)]
        self.known.update(zip(words, [data[i:j] for i, j in zip(begin, end, strict=True)], strict=True))

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        plain, alone, others = [], [], []
        for w in words:
            if w not in self.known:
                special = b"\x01" in w or b"<|" in w
                (alone if special or len(w) > 1000 else plain if self.PLAIN.fullmatch(w.decode()) else others).append(w)
        for w in alone:
            self.known[w] = np.array(self._encode(w.decode()), "<u4").tobytes()
        for start in range(0, len(plain), 20_000):
            part = plain[start : start + 20_000]
            text = self.MATCH.sub("\\g<0>\n", b" ".join(part).decode())
            self._store(part, self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4"), self.space)
        mark = f"\n{self.BETWEEN}\n"
        for start in range(0, len(others), 2000):
            part = others[start : start + 2000]
            self._store(part, np.array(self._encode(mark.join([w.decode() for w in part])), "<u4"), self.between)

    def ids(self, words: list[bytes]) -> bytes:
        """Ids of known words as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Open sequences by fill level; ``number[h]`` counts those filled to ``h``."""

    def __init__(self, size: int = SEQUENCE):
        self.size = size
        self.number = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def level_for(self, length: int) -> int:
        """The level (0: a new sequence) that keeps the sum of squares smallest; among equals the fullest."""
        n, size = self.number, self.size
        leave = n[1 : size - length + 1]
        reach = 2 * n[1 + length : size + 1] + 1
        reach[-1:] = 0  # a full sequence is open no more
        change = np.where(leave > 0, reach - 2 * leave + 1, _FAR)
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * n[length] + 1:
                return best + 1
        return 0

    def add(self, piece: tuple, length: int) -> list | None:
        """Place a piece shorter than a sequence; gives back the pieces of a sequence that it filled."""
        level = self.level_for(length)
        if level:
            held = self.open[level].pop()
            self.number[level] -= 1
        else:
            held = []
        held.append(piece)
        level += length
        if level == self.size:
            return held
        self.open.setdefault(level, []).append(held)
        self.number[level] += 1
        return None

    def rest(self) -> Iterator[list]:
        """What is open, from the fullest level down, each with its pieces in order."""
        for level in sorted(self.open, reverse=True):
            yield from self.open[level]


def pack_documents(df: DataFrame, vocabulary_path: str, end_id: int = 1, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids)."""
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary_path)
        packer = Packer(size)
        rows: list[tuple] = []
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                length = len(ids) // 4
                rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset) + ((ids,) if with_ids else ()))
                offset += length
            sequence += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield arrow_batch(schema, list(map(list, zip(*rows, strict=True))))
                rows.clear()

        for batch in slices(batches):
            texts = [words.words(t or "") for t in batch.column(1).to_pylist()]
            words.learn(set().union(*texts))
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = words.ids(text) + end
                total = len(ids) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    close([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                if whole < total:
                    full = packer.add((doc, whole, ids[4 * whole :], total), total - whole)
                    if full:
                        close(full)
            yield from flush()
        held, room = [], size
        for pieces in packer.rest():
            for doc, start, ids, total in pieces:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    held.append((doc, start, part, total))
                    start += len(part) // 4
                    room -= len(part) // 4
                    if not room:
                        close(held)
                        held, room = [], size
        if held:
            close(held)
        yield from flush()

    ddl = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in schema)
    return id_and_text(df, id_col, text_col).mapInArrow(run, ddl)
