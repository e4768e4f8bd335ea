"""Tokens and their hashes for whole Arrow batches, without a loop over words.

A token is a run of word bytes (ASCII letters and digits, and all bytes of other
characters) or a run of other visible bytes.  ASCII letters are lowered.  Hashes
come from one running sum of ``byte * BASE**position``, so any stretch of a text
(a word, its first bytes) costs two look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAP, WORD, MARK = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.full(256, MARK, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[*range(0, 33), 127]] = GAP
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kind[a:b] = WORD
    low[65:91] += 32
    return kind, low


KIND, LOW = _tables()
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n at least."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 20, 1 << int(n).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0x94D049BB133111EB)


@dataclass
class Tokens:
    """Tokens of some documents: byte ranges, kinds, and where each document's begin."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hash of each token, or of its first ``most`` bytes."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        return mix((self.sums[end] - self.sums[self.start]) * self.inverse[self.start])

    def doc(self) -> np.ndarray:
        """The document of each token."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def tokens(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOW, kinds: np.ndarray = KIND) -> Tokens:
    """Tokens of texts given as bytes and n + 1 offsets; ``table`` maps bytes first."""
    n = len(raw)
    forward, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[table][raw] * forward[:n], out=sums[1:])
    kind = np.zeros(n + 2, np.uint8)
    kind[1:-1] = kinds[raw]
    change = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    of = kind[1:][at]
    real = np.flatnonzero(of != GAP)
    real = real[at[real] < n]
    start, end = at[real], at[real + 1]
    return Tokens(start, end, of[real], np.searchsorted(start, offsets), sums, inverse)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each document's tokens."""
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def hash_word(word: str, table: np.ndarray = LOW) -> int:
    """The hash that ``Tokens.hashes`` gives this word."""
    h, p = 0, 1
    for b in word.encode():
        h = (h + int(_VALUE[table[b]]) * p) & _M64
        p = p * _BASE & _M64
    return int(mix(np.array([h], np.uint64))[0])
