"""Run-length grammars by recompression, and longest common extensions on them, in NumPy.

A sequence of symbols is rewritten level by level, in turn by blocks (a maximal
run of one symbol becomes one symbol named by that symbol and the run's length)
and by pairs (the symbols of a level are split into openers and closers, and
each opener followed by a closer becomes one symbol). What a stretch is
rewritten to depends on its symbols alone but for its ends, so equal stretches
have equal symbols on every level, up to one symbol (or one partial block) at
either end. Two places are compared by climbing while both stand at the edge of
a symbol, and by descending where the symbols differ: a few steps a level.

Many places are compared at once. Nothing is hashed but the choice of openers,
which does not change results.
"""

from __future__ import annotations

import numpy as np

from docweave.llm.wordhash import mix


class Level:
    """Symbols of one level; ``first`` has the first child of each (one more entry than symbols), ``parent`` is set by the next."""

    def __init__(self, symbol: np.ndarray, first: np.ndarray | None = None, blocks: bool = False):
        self.symbol, self.first, self.blocks = symbol, first, blocks
        self.parent = None


def _names(*keys: np.ndarray) -> np.ndarray:
    """Equal numbers, from 0 on, for equal rows."""
    if len(keys) == 1:
        return np.unique(keys[0], return_inverse=True)[1]
    a, b = keys
    width = int(b.max(initial=0)) + 1
    if int(a.max(initial=0)) < (1 << 62) // width:
        return np.unique(a * width + b, return_inverse=True)[1]
    return np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)[1].reshape(-1)


def _blocks(symbol: np.ndarray) -> Level:
    start = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    first = np.append(start, len(symbol))
    return Level(_names(symbol[start], np.diff(first)), first, True)


def _pairs(symbol: np.ndarray, level: int, alone: np.ndarray) -> tuple[Level, np.ndarray]:
    """The next level and its symbols that must stay alone; of a few splits into openers and closers the one with most pairs."""
    best = None
    for seed in range(3):
        opens = (mix(symbol.astype(np.uint64) + np.uint64(1 + 1_000_003 * (3 * level + seed))) & np.uint64(1)).astype(bool)
        joined = opens[:-1] & ~opens[1:] & ~alone[:-1] & ~alone[1:]
        if best is None or joined.sum() > best.sum():
            best = joined
    second = np.concatenate([[False], best])
    start = np.flatnonzero(~second)
    first = np.append(start, len(symbol))
    pair = np.diff(first) == 2
    after = np.where(pair, symbol[np.minimum(start + 1, len(symbol) - 1)] + 1, 0)
    return Level(_names(symbol[start], after), first), alone[start]


class Grammar:
    """Levels over ``symbol`` (integers from 0 on), each sequence in it closed by symbols that occur once (``alone``)."""

    def __init__(self, symbol: np.ndarray, alone: np.ndarray, until: int = 4):
        self.levels = [Level(np.asarray(symbol, np.int64))]
        while np.diff(np.flatnonzero(alone), append=len(alone)).max(initial=0) > until + 1:
            below = self.levels[-1]
            top = _blocks(below.symbol)
            below.parent = np.repeat(np.arange(len(top.symbol)), np.diff(top.first))
            alone = alone[top.first[:-1]]
            self.levels.append(top)
            pairs, alone = _pairs(top.symbol, len(self.levels), alone)
            top.parent = np.repeat(np.arange(len(pairs.symbol)), np.diff(pairs.first))
            self.levels.append(pairs)

    def common(self, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols from places ``a`` and ``b`` on are equal, to the right (the places included) or to the left (included).

        Every comparison must end at a symbol that occurs once, before the ends of the sequence.
        """
        from_a = a
        a, b = a.astype(np.int64), b.astype(np.int64)
        n = len(a)
        sign = 1 if forward else -1
        at = np.zeros(n, np.int64)  # the level where each comparison turned down
        climbing = np.arange(n)
        for number, level in enumerate(self.levels):
            if not len(climbing):
                break
            x, y = a[climbing], b[climbing]
            at[climbing] = number
            if level.parent is None:  # the top: few symbols to a sequence
                while len(climbing):
                    same = level.symbol[a[climbing]] == level.symbol[b[climbing]]
                    climbing = climbing[same]
                    a[climbing] += sign
                    b[climbing] += sign
                break
            above = self.levels[number + 1]
            left_x, left_y = self._left(level, above, x, forward), self._left(level, above, y, forward)
            whole_x, whole_y = (above.first[level.parent[z] + 1] - above.first[level.parent[z]] for z in (x, y))
            edge = (left_x == whole_x) & (left_y == whole_y)
            same = level.symbol[x] == level.symbol[y]
            step = np.where(edge | ~same, 0, np.minimum(left_x, left_y))
            x, y = x + sign * step, y + sign * step
            a[climbing], b[climbing] = x, y
            # both at an edge now: either they were, or what was left of both symbols was equally long
            on = same & (edge | (left_x == left_y))
            climbing, x, y = climbing[on], x[on], y[on]
            a[climbing], b[climbing] = level.parent[x], level.parent[y]
        for number in range(len(self.levels) - 1, -1, -1):
            level = self.levels[number]
            who = np.flatnonzero(at >= number)
            if not len(who):
                continue
            x, y = a[who], b[who]
            same = level.symbol[x] == level.symbol[y]
            if level.parent is not None:
                above = self.levels[number + 1]
                step = same.astype(np.int64)  # of two pairs that differ at most one side is equal
                if above.blocks:
                    step *= np.minimum(self._left(level, above, x, forward), self._left(level, above, y, forward))
                x, y = x + sign * step, y + sign * step
            if number:
                x, y = (level.first[x], level.first[y]) if forward else (level.first[x + 1] - 1, level.first[y + 1] - 1)
            a[who], b[who] = x, y
        return (a - from_a) * sign

    @staticmethod
    def _left(level: Level, above: Level, x: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols from ``x`` to the end (start) of its parent."""
        p = level.parent[x]
        return above.first[p + 1] - x if forward else x - above.first[p] + 1
