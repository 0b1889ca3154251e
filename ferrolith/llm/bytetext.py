"""Vectorised words, lines and windows over the raw UTF-8 bytes of a batch of texts.

Texts arrive as an Arrow binary column; its value buffer is read in place, a few MB of whole documents at a time, so
no Python object is made per word. Hashes are 64-bit; equal byte strings have equal hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown, up to the longest chunk seen."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = _powers[int(base)] = out
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[s:e] of each span."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts])


@dataclass
class Chunk:
    """Whole documents lo..hi-1 of a batch: their bytes, and where each document starts in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def lowered(self) -> Chunk:
        return Chunk(self.lo, self.hi, _LOWER[self.data], self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each run of bytes other than space and tab to carriage return."""
        return self.runs(~_SPACE[self.data])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (from 0 in the chunk) of each run of true bytes; runs end with their document."""
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        before[self.offsets] = False
        start = np.flatnonzero(after & ~before)
        before[1:] = inside
        after[self.offsets] = False
        end = np.flatnonzero(before & ~after)
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line; a document without text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        first, last = self.offsets[:-1], self.offsets[1:]
        start = np.concatenate([first, breaks + 1])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, breaks, side="right") - 1])
        end = np.concatenate([last, breaks])
        order = np.lexsort((start, doc))
        by_end = np.lexsort((end, np.concatenate([np.arange(self.n), doc[self.n :]])))
        return start[order], end[by_end], doc[order]

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Counts, or sums of weights, by document."""
        return np.bincount(doc, weights, self.n).astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a binary column, null as empty, in pieces of about limit bytes; a longer document is a piece alone."""
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def release() -> None:
    """Gives the memory that a task has freed back to the system, where the C library can: workers are kept between
    tasks, and what one has used before would count against the next."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    pa.default_memory_pool().release_unused()


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each window of width words within one document."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:count] == doc[width - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = (out + hashes[at + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return at, mix(out)
