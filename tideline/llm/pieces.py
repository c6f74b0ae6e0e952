"""Ids of texts by way of their distinct segments: parts of a text that a tokenizer treats alone are encoded once and looked up."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

Found = tuple[np.ndarray, np.ndarray]


def flattened(lists: Sequence[Sequence[int]]) -> Found:
    """All ids in a row, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class SegmentIds:
    """A table from segment to ids that takes about `limit` bytes; it is emptied when it is full, so memory has a bound (the limit and
    one call's segments) and results do not change. encode: distinct segments to their ids."""

    _EACH = 180  # bytes of an entry beside its segment and ids

    def __init__(self, encode: Callable[[list[str]], Found], limit: int = 96 << 20):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used, self.held = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, segments: list[bytes]) -> None:
        found, sizes = self.encode([s.decode() for s in segments])
        total, n = len(found), len(sizes)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
        if self.n + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(n, len(x)), np.int64)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = found
        self.start[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        self.place.update(zip(segments, range(self.n, self.n + n), strict=True))
        self.used, self.n = self.used + total, self.n + n
        self.held += self._EACH * n + 4 * total + sum(map(len, segments))

    def _places(self, segments: list[bytes]) -> np.ndarray:
        if self.held > self.limit:
            self._clear()
        at = np.fromiter(map(self.place.get, segments, repeat(-1)), np.int64, len(segments))
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            lacked = [segments[i] for i in lacking.tolist()]
            self._learn(list(dict.fromkeys(lacked)))
            at[lacking] = np.fromiter(map(self.place.__getitem__, lacked), np.int64, len(lacked))
        return at

    def _rows(self, at: np.ndarray, counts: np.ndarray) -> Found:
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], ends])
        return flat, sums[bounds[1:]] - sums[bounds[:-1]]

    def ids(self, texts: list[list[bytes]]) -> Found:
        """For texts given as segments: all ids in a row, and how many each text has."""
        return self._rows(self._places([s for t in texts for s in t]), np.fromiter(map(len, texts), np.int64, len(texts)))

    def array_ids(self, segments: pa.Array, counts: np.ndarray) -> Found:
        """The same for the segments of all texts in a row, and how many each text has; each distinct one is looked up once."""
        coded = segments.dictionary_encode()
        return self._rows(self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()], counts)
