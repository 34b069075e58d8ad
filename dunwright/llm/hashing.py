"""Hashes of all words, shingles and character n-grams of many texts by whole-array operations.

A text's bytes are summed with the powers of an odd base (modulo 2**64), so the hash of any span is a
difference of two prefix sums; a bit mixer makes it uniform.  Hashes depend on nothing but the bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_PLACES = mix(np.arange(1, 17, dtype=np.uint64) * _LENGTH) | np.uint64(1)


def _multiples(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the base and of its inverse."""
    if len(_cache.get("up", ())) <= n:
        size = max(n, 1 << 16) * 5 // 4
        _cache.update(up=_multiples(_BASE, size), down=_multiples(_INVERSE, size))
    return _cache["up"], _cache["down"]


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only
SPACES = byte_set(b" \t\n\x0b\x0c\r")


class Spans:
    """The words of some texts (UTF-8 bytes) and the hashes of their spans."""

    def __init__(self, texts: list[bytes], fold: bytes | None = LOWER, separators=SPACES):
        data = b"\n".join(texts) + b"\n"
        if fold is not None:
            data = data.translate(fold)
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        n = len(self.bytes)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))
        up, self._down = powers(n)
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.bytes] * up[:n], out=self._sum[1:])
        gap = np.ones(n + 1, dtype=bool)
        gap[1:] = separators[self.bytes]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        # words of text i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start]
                   + (end - start).astype(np.uint64) * _LENGTH)

    def words(self) -> np.ndarray:
        return self.span(self.start, self.end)

    def shingles(self, k: int = 5) -> list[np.ndarray]:
        """Per text, the sorted distinct hashes of its k-word shingles; of all its words if fewer."""
        words = self.words()
        whole = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
        for j in range(k):
            whole += words[j:j + len(whole)] * _PLACES[j]
        whole = mix(whole)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(whole[a:b - k + 1]))
            elif b > a:
                few = (words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([few], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out
