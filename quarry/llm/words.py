"""Words of many texts at once, hashed by array operations over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import buffers

SEED = 42
SLICE = 4 << 20  # bytes of text worked on at once, at least one text
LONG = 64  # bytes of a word that are hashed at once for all words
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWERED = np.frombuffer(LOWER, np.uint8)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
START, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # of FNV-1a
MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def slices(column: pa.Array, most: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of up to so many rows and SLICE bytes, or of one longer text; a null is empty."""
    raw, at = buffers(column)
    a = 0
    while a < len(at) - 1:
        b = min(a + most, max(a + 1, int(np.searchsorted(at, at[a] + SLICE, "right")) - 1))
        yield a, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, bytes, place of the first byte) of each word of the rows at the offsets, A-Z lower-cased or not: FNV-1a of the
    first LONG bytes, then mixed with an XXH64 of what a longer word has beyond them. Words are parted by the six ASCII white spaces."""
    raw = LOWERED[raw] if lower else raw
    inside = ~WHITE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.diff(at) > 0
    begin, end = at[:-1][filled], at[1:][filled] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts = np.nonzero(first)[0]
    length = np.nonzero(last)[0] + 1 - starts
    h, live = np.full(len(starts), START), np.arange(len(starts))
    for k in range(LONG):
        live = live[length[live] > k]
        if not len(live):
            break
        h[live] = (h[live] ^ raw[starts[live] + k]) * PRIME
    for i in np.nonzero(length > LONG)[0].tolist():
        h[i] ^= np.uint64(xxhash.xxh64_intdigest(raw[starts[i] + LONG : starts[i] + length[i]].tobytes(), SEED))
    return mixed(h), np.searchsorted(at, starts, "right") - 1, length, starts


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, up to the n-th."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        base = int(MIX[3]) | 1
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, np.uint64(x % 2**64))))) for x in (base, pow(base, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


class Sequence:
    """Hashes of any runs of a sequence of hashes, by their order, from one running sum."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _powers(len(hashes))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))

    def of(self, a: np.ndarray, b: np.ndarray, tag: int = 0) -> np.ndarray:
        """The runs [a, b); runs of other lengths or tags differ."""
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * MIX[4] + np.uint64(tag))
