"""Hashes of words and of runs of words, for many texts at once, in NumPy.

Texts are laid end to end as bytes. A word's hash depends on its bytes alone, a
run's hash on its words alone, so equal runs have equal 64-bit hashes wherever
they stand.
"""

from __future__ import annotations

import numpy as np

_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_C_INV = _inverse(_C)


class Words:
    """The words of several texts.

    ``start`` and ``end`` are byte places in ``data``, ``first`` gives the index of
    each text's first word (one more entry than texts), ``hash`` the words' hashes.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        b = self.data
        sep = (b == 32) | ((b >= 9) & (b <= 13))
        change = np.flatnonzero(np.diff(sep, prepend=True))
        self.start, self.end = change[0::2], change[1::2]
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        self.text_at = np.concatenate([[0], ends])[:-1] if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
        self.hash = self._hash(b)

    def _hash(self, b: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        total = int(size.sum())
        place = np.arange(total, dtype=np.int64)
        begin = np.cumsum(size) - size
        inside = place - np.repeat(begin, size)
        value = (b[inside + np.repeat(self.start, size)].astype(np.uint64) + np.uint64(1)) * powers(_A, int(size.max()))[inside]
        return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _M2)

    def runs(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on, across text ends; for the last words, of what is left."""
        h = self.hash
        n = len(h)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(_C, n)[:n], out=total[1:])
        until = np.minimum(np.arange(n) + k, n)
        return mix((total[until] - total[:n]) * powers(_C_INV, n)[:n])

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        n = np.diff(self.first)
        return np.repeat(self.first[1:], n) - np.arange(len(self.hash))
