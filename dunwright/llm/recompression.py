"""Recompression of integer strings into a run-length grammar, and extension queries on it.

Rounds alternate two steps.  Block compression replaces every maximal run of one symbol by one symbol;
pair compression splits the symbols into left and right ones and replaces every left-right pair.  Equal
stretches are parsed alike but for their edges, so the longest common extension of two places is found by
climbing the levels while both places start (or end) a symbol of the next one, and descending after the first
difference: at most two comparisons a level, for all queries at once.

The grammar holds many strings in one.  A separator of its own stands before, between and after them and
never enters a pair; rounds end when every string is one symbol.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix


class Grammar:
    """``strings`` are non-empty arrays of non-negative integers; ``place[k]`` is where string k starts."""

    def __init__(self, strings: list[np.ndarray]):
        n = sum(map(len, strings)) + len(strings) + 1
        symbols = np.empty(n, dtype=np.int64)
        self.place = np.empty(len(strings), dtype=np.int64)
        top = max(int(s.max()) for s in strings) + 1
        self._separators = (top, top + len(strings) + 1)
        symbols[0], at = top, 1
        for k, s in enumerate(strings):
            self.place[k] = at
            symbols[at:at + len(s)] = s
            at += len(s) + 1
            symbols[at - 1] = top + 1 + k
        self._fresh = top + len(strings) + 1
        self.symbols, self.starts, self.parents = [symbols], [], []  # starts[h]: first children in level h
        while len(self.symbols[-1]) > 2 * len(strings) + 1:
            self._blocks()
            self._pairs()

    def _rename(self, keys: np.ndarray) -> np.ndarray:
        _, names = np.unique(keys, return_inverse=True)
        names = names + self._fresh
        if len(names):
            self._fresh = int(names.max()) + 1
        return names

    def _next(self, first: np.ndarray, replaced: np.ndarray, names: np.ndarray) -> None:
        """A new level whose symbols start where ``first``; ``replaced`` starts get ``names``."""
        starts = np.flatnonzero(first)
        symbols = self.symbols[-1][starts].copy()
        symbols[replaced] = names
        self.parents.append(np.cumsum(first) - 1)
        self.starts.append(np.append(starts, len(first)))
        self.symbols.append(symbols)

    def _blocks(self) -> None:
        s = self.symbols[-1]
        first = np.ones(len(s), dtype=bool)
        first[1:] = s[1:] != s[:-1]
        starts = np.flatnonzero(first)
        length = np.diff(np.append(starts, len(s)))
        long = np.flatnonzero(length > 1)
        self._next(first, long, self._rename(s[starts[long]] * (len(s) + 1) + length[long]))

    def _pairs(self) -> None:
        s = self.symbols[-1]
        merges = (s < self._separators[0]) | (s >= self._separators[1])
        right = (mix(s.astype(np.uint64) + np.uint64(len(self.symbols) << 40)) & np.uint64(1)).astype(bool)
        both = merges[:-1] & merges[1:]
        pair = both & ~right[:-1] & right[1:]
        other = both & right[:-1] & ~right[1:]
        if other.sum() > pair.sum():  # the other way round replaces more
            pair = other
        first = np.ones(len(s), dtype=bool)
        first[1:] = ~pair
        starts = np.flatnonzero(first)
        at = np.flatnonzero(pair[np.minimum(starts, len(pair) - 1)] & (starts < len(pair)))
        left = starts[at]
        self._next(first, at, self._rename(s[left] * self._fresh + s[left + 1]))

    def mismatch(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Where, going from ``a`` by ``step`` (1 or -1), the symbol first differs from the one as far from ``b``.

        The places of a query are different and in one string, so its separators end every extension.
        """
        a, b = a.copy(), b.copy()
        height = np.zeros(len(a), dtype=np.int64)
        active = np.arange(len(a))
        for h in range(len(self.starts)):  # up
            s, x, y = self.symbols[h], a[active], b[active]
            same = s[x] == s[y]
            active, x, y = active[same], x[same], y[same]
            if not len(active):
                break
            inner = ~(self._edge(h, x, step) & self._edge(h, y, step))
            go = np.flatnonzero(inner)
            move = self._rest(h, x[go], y[go], step)
            x[go] += step * move
            y[go] += step * move
            a[active], b[active] = x, y
            same = s[x] == s[y]
            active, x, y = active[same], x[same], y[same]
            a[active], b[active] = self.parents[h][x], self.parents[h][y]
            height[active] = h + 1
        for h in range(int(height.max(initial=0)), 0, -1):  # down
            down = np.flatnonzero(height >= h)
            starts, s = self.starts[h - 1], self.symbols[h - 1]
            if step > 0:
                x, y = starts[a[down]], starts[b[down]]
            else:
                x, y = starts[a[down] + 1] - 1, starts[b[down] + 1] - 1
            go = np.flatnonzero(s[x] == s[y])
            move = self._rest(h - 1, x[go], y[go], step)
            x[go] += step * move
            y[go] += step * move
            a[down], b[down] = x, y
        return a

    def _edge(self, h: int, x: np.ndarray, step: int) -> np.ndarray:
        """Whether places of level h start (or end) their symbol of level h + 1."""
        parent = self.parents[h][x]
        return self.starts[h][parent] == x if step > 0 else self.starts[h][parent + 1] - 1 == x

    def _rest(self, h: int, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How far two equal places agree for certain: the shorter rest of a block, or one symbol."""
        if h % 2:  # pairs are made of odd levels
            return np.ones(len(x), dtype=np.int64)
        starts, parents = self.starts[h], self.parents[h]
        if step > 0:
            return np.minimum(starts[parents[x] + 1] - x, starts[parents[y] + 1] - y)
        return np.minimum(x - starts[parents[x]], y - starts[parents[y]]) + 1
