"""Byte-level BPE over ranks: merging, splitting of text, joining of encodings.

Two facts carry the operators built on this module.

* Splitting: the pattern never matches across a space that stands between two
  non-space characters, so a text may be cut before every such space and each
  piece be split by itself (``pieces``).
* Joining: a token sequence is the encoding of its bytes exactly when every two
  neighbours are the encoding of their own concatenation (``fits``). So an
  encoding may be changed in one window and stays right outside as soon as the
  window's first and last tokens fit the tokens next to it.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import regex

#: Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TOKENS = regex.compile(PATTERN)
#: Texts of these characters only are split by the plain pattern below, which is faster.
_PLAIN_ONLY = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PLAIN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r\x20A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+""")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_LOOSE = re.compile(r"\s | \s|^ | $")
DIRECT = 64  # longer matches are halved


def split(text: str) -> list[str]:
    """All matches of the pattern, in order."""
    return (_PLAIN if _PLAIN_ONLY.fullmatch(text) else _TOKENS).findall(text)


def pieces(text: str) -> list[str]:
    """Cut a text before each space that stands between two non-space characters."""
    if not text:
        return []
    if _LOOSE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


class RankBPE:
    """Encoder for one table of ``token bytes -> rank``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pair: dict[int, bool] = {}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> RankBPE:
        """Ranks of a ``.tiktoken`` file, or of the vocabulary of a byte-level ``.json`` file."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            back = {c: b for b, c in printable().items()}
            as_bytes = lambda s: bytes(back[c] for c in s)
            order = {"".join(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
            ids = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
            base = sorted((b for b in ids if len(b) == 1), key=ids.get)
            merged = sorted((t for t in model["vocab"] if t in order), key=order.get)
            return RankBPE({b: i for i, b in enumerate([*base, *map(as_bytes, merged)])})
        with open(path, "rb") as f:
            return RankBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """Merge the neighbours of lowest rank until none is left; quadratic, for short strings."""
        get = self.ranks.get
        if (whole := get(data)) is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        pair = [get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            best = None
            at = -1
            for i, r in enumerate(pair):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = get(parts[at - 1] + parts[at])

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``a`` followed by ``b`` is the encoding of their bytes."""
        known = self.pair.get(a << 20 | b)
        if known is None:
            if len(self.pair) > 1_500_000:
                self.pair.clear()
            known = self.pair[a << 20 | b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int], count: list[int]) -> None:
        """Add, for every prefix of ``data`` longer than those given, its last token and its number of tokens.

        Exactly one token ends a prefix such that it fits the last token of the prefix before it.
        """
        get, known, longest = self.ranks.get, self.pair.get, self.longest
        for end in range(len(last), len(data) + 1):
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                t = get(data[start:end])
                if t is None:
                    continue
                if start:
                    ok = known(last[start] << 20 | t)
                    if ok is None:
                        ok = self.fits(last[start], t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[start] + 1)
                break

    def search(self, data: bytes) -> list[int]:
        """The sequence whose neighbours all fit: longest tokens first, stepping back from dead ends.

        The encoding of every prefix is unique, so an end found dead once stays dead.
        """
        get, known, n = self.ranks.get, self.pair.get, len(data)
        if (whole := get(data)) is not None:
            return [whole]
        ids: list[int] = []
        ends: list[int] = [0]
        dead: set[int] = set()
        at, end, last = 0, min(n, self.longest), -1
        while at < n:
            while end > at:
                t = get(data[at:end])
                if t is not None and end not in dead:
                    if last < 0:
                        break
                    ok = known(last << 20 | t)
                    if ok is None:
                        ok = self.fits(last, t)
                    if ok:
                        break
                end -= 1
            if end > at:
                ids.append(t)
                ends.append(end)
                at, end, last = end, min(n, end + self.longest), t
            else:
                dead.add(at)
                ids.pop()
                end = ends.pop() - 1
                at = ends[-1]
                last = ids[-1] if ids else -1
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of what ``left`` and ``right`` encode.

        A window around the seam is encoded anew and grows on each side on which
        its outermost token does not fit the token next to it.
        """
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            data = b"".join([self.token[t] for t in [*left[len(left) - i :], *right[:j]]])
            window = self.search(data)
            good_left = i == len(left) or self.fits(left[-i - 1], window[0])
            good_right = j == len(right) or self.fits(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)

    def encode(self, data: bytes) -> list[int]:
        """Encoding of one match of the pattern: halves, joined."""
        if len(data) <= DIRECT:
            return self.search(data) if data else []
        mid = len(data) // 2
        return self.join(self.encode(data[:mid]), self.encode(data[mid:]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


def printable() -> dict[int, str]:
    """The public mapping of bytes to visible characters that ``.json`` vocabularies are written in."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out
