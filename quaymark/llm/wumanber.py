"""Multi-pattern search in bytes, by block shift tables.

For every block of bytes the table says how far its last place within the first `m` bytes of any
pattern is from their end (m: the shortest pattern). A place whose block has a shift above zero
can't end a pattern's start, nor can those before its shift's end: they are skipped and never
looked at. A block with shift zero leads to the bucket of patterns whose start ends in it, and
these are compared byte by byte. Long buffers are searched in many lanes side by side: each lane
has its stretch of places and moves on by its own shifts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes in a block, at most 8; places a lane has at least, and lanes at most.
BLOCK = 6
LANE, LANES = 256, 8192
_WORD = 8


def padded(data: bytes) -> np.ndarray:
    """The bytes with room for reading whole words past the end."""
    return np.frombuffer(data + b"\0" * (2 * _WORD), np.uint8)


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without copying."""
    return np.ndarray(len(buf) - _WORD + 1, "<u8", buf, strides=(1,))


def _mask(n: np.ndarray | int) -> np.ndarray:
    """The lowest n bytes, n from 0 to 8."""
    n = np.asarray(n, np.uint64)
    return np.where(n >= _WORD, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(n, np.uint64(_WORD - 1)) * np.uint64(8))) - np.uint64(1))


class Patterns:
    """Patterns of at least one byte; equal ones may repeat."""

    def __init__(self, patterns: Sequence[bytes], bits: int = 18) -> None:
        self.lengths = np.asarray([len(p) for p in patterns], np.int64)
        self.m = int(self.lengths.min())
        self.block = min(BLOCK, self.m)
        self.bits = bits
        self.mask = _mask(self.block)
        self.flat = padded(b"".join(patterns))
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        words = _words(self.flat)
        self.shift = np.full(1 << bits, self.m - self.block + 1, np.int32)
        for q in range(self.block, self.m + 1):  # the block that ends before place q of each start
            ends = words[self.first + (q - self.block)] & self.mask
            np.minimum.at(self.shift, self._slot(ends), self.m - q)
        self.by_end = np.argsort(ends, kind="stable")
        self.end_keys = ends[self.by_end]

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((blocks * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ends(self, words: np.ndarray, n: int) -> tuple[np.ndarray, int]:
        """(places whose block has shift zero, number of places looked at) among the first n places."""
        lanes = int(min(max(n // LANE, 1), LANES))
        border = np.linspace(0, n, lanes + 1).astype(np.int64)
        at, stop = np.maximum(border[:-1], self.m - 1), border[1:]
        found, looked = [], 0
        at, stop = at[at < stop], stop[at < stop]
        while len(at):
            looked += len(at)
            by = self.shift[self._slot(words[at - (self.block - 1)] & self.mask)]
            hit = by == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(by, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return (np.concatenate(found) if found else np.empty(0, np.int64)), looked

    def find(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all occurrences in a padded buffer."""
        words, n = _words(buf), len(buf) - 2 * _WORD
        at, _ = self.ends(words, n)
        blocks = words[at - (self.block - 1)] & self.mask
        lo = np.searchsorted(self.end_keys, blocks)
        count = np.searchsorted(self.end_keys, blocks, "right") - lo
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        start = np.repeat(at, count) - (self.m - 1)
        k = self.by_end[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        ok = start + self.lengths[k] <= n
        start, k = start[ok], k[ok]
        own = _words(self.flat)
        done = 0
        while len(start) and (self.lengths[k] > done).any():
            rest = _mask(np.clip(self.lengths[k] - done, 0, _WORD))
            skip = np.minimum(done, self.lengths[k])  # finished ones compare nothing
            same = ((words[start + skip] ^ own[self.first[k] + skip]) & rest) == 0
            start, k = start[same], k[same]
            done += _WORD
        order = np.lexsort((k, start))
        return start[order], k[order]
