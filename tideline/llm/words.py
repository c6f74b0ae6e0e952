"""Vectorised words, word windows and polynomial hashes over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The ASCII bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE, _WORD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size, inverse = 1 << max(12, n.bit_length()), pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p, m = np.ones(1, np.uint64), b
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(m)])
                m = m * m % (1 << 64)
            out.append(p)
        have = out[0], out[1]
        if size <= 1 << 22:  # tables for longer texts are not kept
            _powers[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins and ends. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most `limit` bytes, or a single longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


class Words:
    """The words of some texts: hash holds a 64-bit hash of each word, text its text's place, first the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        power, inverse = powers(_BYTE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        self.hash = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_WORD))
        self.starts, self.ends = starts, ends
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(n + 1))

    def windows(self, k: int, base: int = _WORD) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of all runs of k words inside one text, and the first word of each."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        power, inverse = powers(base, m + 1)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(self.hash * power[:m], out=sums[1:])
        at = np.flatnonzero(self.text[: m - k + 1] == self.text[k - 1 :])
        return mixed((sums[at + k] - sums[at]) * inverse[at]), at
