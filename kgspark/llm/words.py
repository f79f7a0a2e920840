"""Words of many texts as numbers, by array operations: spans, 64-bit hashes, a hash table, lists of ids.

No word becomes a Python object. Words are told apart by their hashes, whose constants are fixed, so
all workers give a word the same one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII capitals to small letters; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(61)
_BYTES = _rng.integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bytes that are hashed at once, but for a word that is longer.
SEGMENT = 1 << 18

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        known = np.cumprod(out, dtype=np.uint64)
        if n <= 2 * SEGMENT:
            _powers[int(base)] = known
    return known[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in a row, and where each row begins, with the end; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[int(at[0]) : int(at[-1])] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last places (the last excluded) of all words [^\\x20\\x09-\\x0D]+ of the rows, and how many words each row has."""
    word = ~_SPACE[raw]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    starts[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are in order and don't overlap."""
    out = np.zeros(len(s), np.uint64)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + SEGMENT, "right")))
        low, high = int(s[at]), int(e[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * _power(_BASE, high - low), out=total[1:])
        first = s[at:to] - low
        out[at:to] = (total[e[at:to] - low] - total[first]) * _power(_INVERSE, high - low)[first]
        at = to
    return mixed(out + (e - s).astype(np.uint64))


def take_ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces data[start : start + size] in a row."""
    size = size.astype(np.int64)
    place = np.repeat(start - (np.cumsum(size) - size), size)
    place += np.arange(len(place))
    return data[place]


class Numbers:
    """Numbers for 64-bit keys: an open hash table in arrays."""

    def __init__(self):
        self._make(16)
        self.keys = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.keys)

    def _make(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)
        self.held = np.zeros(1 << bits, np.uint64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self._slot(h)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & (self.held[slot] != h))
        last = (1 << self.bits) - 1
        while len(left):
            slot[left] = (slot[left] + 1) & last
            own = slot[left]
            out[left] = got = self.slots[own]
            left = left[(got >= 0) & (self.held[own] != h[left])]
        return out

    def _put(self, h: np.ndarray, first: int) -> None:
        slot, number, last = self._slot(h), np.arange(first, first + len(h), dtype=np.int32), (1 << self.bits) - 1
        left = np.arange(len(h))
        while len(left):
            own = slot[left]
            free = self.slots[own] < 0
            self.slots[own[free]] = number[left[free]]
            won = self.slots[own] == number[left]
            self.held[own[won]] = h[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & last

    def add(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, and the places in h of keys that are new, in the order of their numbers."""
        out = self.find(h)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, missing
        new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
        before = len(self.keys)
        self.keys = np.concatenate([self.keys, new])
        if 2 * len(self.keys) > len(self.slots):
            self._make(max(16, int(np.ceil(np.log2(len(self.keys)))) + 2))
            self._put(self.keys, 0)
        else:
            self._put(new, before)
        out[missing] = before + which.ravel()
        return out, missing[first]


class Lists:
    """Lists of ids in one array, by number."""

    def __init__(self):
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        start = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids, self.start, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.start, start]), np.concatenate([self.size, size.astype(np.int32)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers in a row, and their sizes."""
        size = self.size[at].astype(np.int64)
        return take_ragged(self.ids, self.start[at], size), size
