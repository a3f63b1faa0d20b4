"""Words, word hashes and word shingles of byte buffers, for whole batches.

A word's hash is a polynomial in random 64-bit byte values, taken from one
running sum over the buffer; a shingle mixes the hashes of its words.  Equal
words have equal hashes; two of the (at most a few thousand) shingles of a
compared pair collide with a probability under 1e-12.
"""
from __future__ import annotations

import numpy as np

# White space is 0x20 and 0x09-0x0D; only A-Z are lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_BYTE = _BYTE[LOWER]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_PLACE = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_spans(buf: np.ndarray, off: np.ndarray,
               space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the
    rows; ``space`` tells the bytes that part words."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = True) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[buf] * up[:len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(hashes: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, and the n + 1 offsets.
    A row of 1 to k - 1 words gives its whole sequence as one shingle."""
    count = np.diff(woff)
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(woff), np.int64)
    m = len(hashes)
    padded = np.concatenate([hashes, np.zeros(k - 1, np.uint64)])
    run = np.zeros(m, np.uint64)
    for j in range(k):
        run += padded[j:j + m] * _PLACE[j]
    keep = np.ones(m, bool)
    long_rows = count >= k
    tails = (woff[1:][long_rows, None] - np.arange(1, k)[None, :]).ravel()
    keep[tails] = False
    for r in np.flatnonzero((count > 0) & ~long_rows):  # rows shorter than a shingle
        a, b = woff[r], woff[r + 1]
        keep[a + 1:b] = False
        run[a] = np.append(hashes[a:b] * _PLACE[:b - a], _PLACE[32 + b - a]).sum(dtype=np.uint64)
    soff = np.concatenate([[0], np.cumsum(keep)])[woff]
    return mix(run[keep]), soff


def text_shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    s, e, woff = word_spans(buf, off)
    return shingle_hashes(word_hashes(buf, s, e), woff, k)


class Lookup:
    """An open-addressing table from distinct 64-bit keys to row numbers,
    built and probed with whole arrays: 4 bytes a slot, 3 to 6 slots a key."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys = np.ascontiguousarray(keys, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rows, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of several rows for a slot the last stays
            lost = self.slots[at] != rows
            rows, at = rows[lost], (at[lost] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 if absent."""
        if len(self.keys) == 0:
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        row = self.slots[at]
        open_ = np.flatnonzero((self.keys[row] != keys) & (row >= 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            row[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[row[open_]] != keys[open_]) & (row[open_] >= 0)]
        return row
