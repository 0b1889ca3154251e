"""Token ids of words, each distinct word encoded once while it is remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ferrolith.llm.bytetext import span_hashes

KNOWN_WORDS = 2_000_000


class KnownIds:
    """Remembers the ids of words by their 64-bit hashes, in sorted numpy arrays.

    encode(words) gives the ids of byte strings, one after another, and how many each has. limit bounds what is kept
    from one call to the next: where new words would pass it, all is forgotten first and every word of the call is
    encoded again, so a call with more words than limit is right too and holds just its own.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = KNOWN_WORDS):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def _known(self, distinct: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, distinct)
        inside = at < len(self.hashes)
        known = np.zeros(len(distinct), bool)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        return known

    def _remember(self, hashes: np.ndarray, words: list[bytes]) -> None:
        flat, sizes = self.encode(words)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(flat), "<u4")])
        self.flat[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.sizes = np.insert(self.hashes, at, hashes), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def ids(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words data[begin:stop], in order, and how many each has."""
        distinct, first, which = np.unique(span_hashes(data, begin, stop), return_index=True, return_inverse=True)
        known = self._known(distinct)
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > self.limit:
                self._forget()
                known[:] = False
            new, body = first[~known], data.tobytes()
            self._remember(distinct[~known], [body[a:b] for a, b in zip(begin[new].tolist(), stop[new].tolist())])
        at = np.searchsorted(self.hashes, distinct)
        sizes = self.sizes[at][which]
        total = int(sizes.sum())
        source = np.repeat(self.starts[at][which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return self.flat[source], sizes
