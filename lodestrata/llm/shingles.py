"""Sets of word shingles as arrays of 64-bit hashes. A word's hash comes from all its bytes."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The first 0 to 8 bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONGEST = 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    fresh = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h if fresh.all() else h[fresh]


class Shingler:
    """Shingles of ``k`` words: runs of other characters than ASCII white space, A-Z lower-cased."""

    def __init__(self, k: int):
        self.k = k

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word of all texts, in order, from its bytes, eight at a time; and how many each text has."""
        parts = [t.encode() for t in texts]
        joined = b"\n".join(parts).lower()  # of bytes: ASCII letters only
        raw = np.frombuffer(joined + bytes(8), np.uint8)
        edge = np.flatnonzero(np.diff(~_SPACE[raw[: len(joined)]], prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        eight = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(joined) + 1,), (1,))
        rest = ends - starts
        h = rest.astype(np.uint64) * _FACTOR
        at, left, own = starts, rest, np.arange(len(starts))
        while len(own):
            h[own] = mixed(h[own] * _FACTOR + (eight[at] & _BYTES[np.minimum(left, 8)]))
            more = (left > 8) & (rest[own] <= LONGEST)
            own, at, left = own[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(rest > LONGEST).tolist():
            h[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
        close = np.cumsum([len(p) + 1 for p in parts])
        return h, np.diff(np.searchsorted(starts, close), prepend=0)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The distinct shingles of each text, ascending; with fewer than ``k`` words the whole sequence is one."""
        w, counts = self.words(texts)
        grams, out, at = self._grams(w, self.k), [], 0
        for n in counts.tolist():
            own = grams[at : at + n - self.k + 1] if n >= self.k else self._grams(w[at : at + n], n) if n else w[:0]
            out.append(distinct(own))
            at += n
        return out

    def _grams(self, w: np.ndarray, k: int) -> np.ndarray:
        if len(w) < k:
            return w[:0]
        h = np.full(len(w) - k + 1, np.uint64(k))
        for i in range(k):
            h = mixed(h * _FACTOR + w[i : len(w) - k + 1 + i])
        return h

    def __call__(self, text: str) -> np.ndarray:
        return self.sets([text])[0]


def signature(shingles: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
