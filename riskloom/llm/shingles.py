"""Word shingles of whole texts as 64-bit hashes, computed for blocks of texts at once.

Words are maximal runs of bytes other than space and U+0009 to U+000D, with A to Z lower-cased. A text with fewer
words than a shingle has its whole sequence as one shingle; a text that is null or has no words has none.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Hashes of words by prefix sums of a polynomial; holds the powers of its base."""

    def __init__(self, words: int):
        self.words = words
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, _BASE, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)

    def _segment(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = _SEPARATOR[data]
        edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + _U(1)) * self.powers[: len(data)], out=sums[1:])
        return start, mix((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def _word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word; long blocks go in segments that end at a separator."""
        if len(data) <= _SEGMENT:
            return self._segment(data)
        starts, hashes, at = [], [], 0
        while at < len(data):
            stop = min(len(data), at + _SEGMENT)
            while stop < len(data):
                ends = np.flatnonzero(_SEPARATOR[data[stop:stop + _SEGMENT]])
                if len(ends):
                    stop += int(ends[0]) + 1
                    break
                stop = min(len(data), stop + _SEGMENT)
            s, h = self._segment(data[at:stop])
            starts.append(s + at)
            hashes.append(h)
            at = stop
        return np.concatenate(starts), np.concatenate(hashes)

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of all texts, sorted within each text, and their number for each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        start, word = self._word_hashes(data)
        first = np.searchsorted(start, np.cumsum(sizes) - sizes)
        last = np.append(first[1:], len(start))
        n = self.words
        out, counts = [], np.zeros(len(texts), dtype=np.int64)
        rolled = word.copy()
        for k in range(1, n):
            rolled[: len(word) - k] = mix(rolled[: len(word) - k] * _U(_BASE) + word[k:])
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            if b - a >= n:
                found = np.unique(rolled[a:b - n + 1])
            elif b > a:
                whole = word[a:a + 1]
                for k in range(a + 1, b):
                    whole = mix(whole * _U(_BASE) + word[k:k + 1])
                found = mix(whole + _U(b - a))
            else:
                continue
            out.append(found)
            counts[i] = len(found)
        return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts
