"""Compressed bitmaps over 32-bit codes.

The code space is cut into ranges of 2**16.  A range with few codes keeps them
as a sorted list of 16-bit numbers, a fuller one as 2**16 bits, whichever is
smaller.
"""

from __future__ import annotations

import numpy as np

RANGE_BITS = 16
#: A list of more codes than this is larger than the bits of the whole range.
LIST_LIMIT = (1 << RANGE_BITS) // 16


class Bitmap:
    """A set of codes; made from distinct codes in any order."""

    __slots__ = ("ranges",)

    def __init__(self, codes: np.ndarray = ()) -> None:
        self.ranges: dict[int, np.ndarray] = {}
        codes = np.sort(np.asarray(codes, dtype=np.uint32))
        if not len(codes):
            return
        high = codes >> RANGE_BITS
        starts = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])
        for start, end in zip(starts, [*starts[1:], len(codes)], strict=True):
            self.ranges[int(high[start])] = _pack((codes[start:end] & 0xFFFF).astype(np.uint16))

    def and_not(self, other: Bitmap) -> Bitmap:
        """The codes of this set that ``other`` doesn't hold."""
        result = Bitmap()
        for high, mine in self.ranges.items():
            theirs = other.ranges.get(high)
            left = mine if theirs is None else _and_not(mine, theirs)
            if len(left):
                result.ranges[high] = left
        return result

    def codes(self) -> np.ndarray:
        """All codes, in ascending order."""
        parts = [np.uint32(high << RANGE_BITS) + _unpack(self.ranges[high]) for high in sorted(self.ranges)]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _pack(low: np.ndarray) -> np.ndarray:
    """List (uint16) or bits (uint8) of one range."""
    if len(low) <= LIST_LIMIT:
        return low
    flags = np.zeros(1 << RANGE_BITS, np.uint8)
    flags[low] = 1
    return np.packbits(flags)


def _unpack(part: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint16:
        return part.astype(np.uint32)
    return np.flatnonzero(np.unpackbits(part)).astype(np.uint32)


def _and_not(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    if mine.dtype == np.uint16:
        if theirs.dtype == np.uint16:
            return mine[~np.isin(mine, theirs, assume_unique=True)]
        return mine[(theirs[mine >> 3] >> (7 - (mine & 7))) & 1 == 0]
    bits = mine.copy()
    if theirs.dtype == np.uint16:
        flags = np.zeros(1 << RANGE_BITS, np.uint8)
        flags[theirs] = 1
        theirs = np.packbits(flags)
    bits &= ~theirs
    return _pack(_unpack(bits).astype(np.uint16))
