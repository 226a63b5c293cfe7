"""Words of many texts at once, as flat numpy arrays over UTF-8 bytes.

A word is a run of ASCII letters or digits and non-ASCII bytes, lower-cased; ideographs and kana
are words of their own. Every function here works on whole texts, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 2
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Flat view of a string array: bytes, word starts and ends, and the row of each word."""

    def __init__(self, col: pa.Array, lower: bool = True):
        text = pc.fill_null(col, "")
        if lower:
            text = pc.utf8_lower(text)
        if pa.types.is_large_string(text.type) is False:
            text = text.cast(pa.large_string())
        n = len(text)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
        size = int(offsets[-1] - offsets[0]) if n else 0
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        self.rows = n
        self.n_bytes = lengths
        self.begin = (offsets[:-1] - (offsets[0] if n else 0)) + PAD * (np.arange(n) + 1)  # where each text starts in raw
        self.raw = np.full(size + PAD * (n + 1), 32, dtype=np.uint8)
        if size:
            self.raw[np.arange(size) + np.repeat(PAD * (np.arange(n) + 1), lengths)] = data
        inside = _WORD[self.raw]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        first = inside & (~before | (self.raw >= 0xE3))
        self.starts = np.flatnonzero(first)
        last = np.empty_like(inside)
        last[-1], last[:-1] = inside[-1], inside[:-1] & (~inside[1:] | first[1:])
        self.ends = np.flatnonzero(last) + 1
        self.inside = inside
        self.row = np.searchsorted(self.begin, self.starts, side="right") - 1
        self.counts = np.bincount(self.row, minlength=n) if n else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(self.inside)
        lengths = self.ends - self.starts
        bounds = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = (np.arange(len(at)) - np.repeat(bounds, lengths)) & 1023
        return mix(np.add.reduceat(_BYTE[self.raw[at]] * _PLACE[place], bounds))


def shingles(h: np.ndarray, row: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `width` words; a shorter text gives one of all its words."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(len(h), np.uint64)
    position = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - position
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:] * _PLACE[k + 1]
        part[left <= k] = 0
        acc += part
    keep = (left >= width) | (position == 0)
    return mix(acc[keep]), row[keep]
