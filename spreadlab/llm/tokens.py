"""Words, shingles and fingerprints of Arrow text columns, with numpy inside tasks.

Texts are taken in runs of about a megabyte, so what a task holds does not depend on its
partition; a longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
SLOTS = 64

_random = np.random.Generator(np.random.PCG64(20240607))
#: One random number for each place in a word and byte there: a word's hash is their sum.
_TABLE = _random.integers(0, 1 << 64, size=SLOTS * 256, dtype=np.uint64)
#: Odd multipliers for words by their place in a window.
PLACES = _random.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)

BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds from 0) of runs of whole texts."""
    data, bounds = text_bytes(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + run_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


class Words:
    """The words of a run of texts: starts, ends, hashes, and `at`, the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool = False):
        self.data, self.bounds = data, bounds
        if len(data) == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self.at = np.zeros(len(bounds), np.int64)
            return
        inside = ~BLANK[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = bounds[(bounds > 0) & (bounds < len(data))]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.at = np.searchsorted(self.starts, bounds)
        letters = LOWER[data] if fold else data
        lengths = self.ends - self.starts
        total = int(lengths.sum())
        if total == 0:
            self.hashes = np.zeros(0, np.uint64)
            return
        begin = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=begin[1:])
        place = np.arange(total) - np.repeat(begin, lengths)
        value = _TABLE[(place % SLOTS) * 256 + letters[inside]]
        far = np.flatnonzero(place >= SLOTS)
        if len(far):
            value[far] *= np.uint64(2) * mixed((place[far] // SLOTS).astype(np.uint64) * _FAR) + np.uint64(1)
        self.hashes = mixed(np.add.reduceat(value, begin))

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def windows(self, width: int) -> np.ndarray:
        """Hash of the `width` words from each word on; near a text's end it reaches over and means nothing."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.hashes[:n] * PLACES[0]
        for j in range(1, width):
            out += self.hashes[j : j + n] * PLACES[j]
        return mixed(out)


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each `width` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some `width` neighbouring positions, ties included.

    Equal stretches of `width` hashes select equal positions, whatever stands around them.
    """
    least = sliding(hashes, width, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    fill = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(hashes == sliding(np.concatenate([fill, least, fill]), width, np.maximum))


def capped_counts(values: np.ndarray) -> np.ndarray:
    """Each distinct value once, and twice if it occurs more often."""
    found, counts = np.unique(values, return_counts=True)
    return np.concatenate([found, found[counts > 1]])


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


class Summary:
    """Counts of frequent keys in bounded memory: when it is full, the rarest half go."""

    def __init__(self, most: int):
        self.most, self.parts = most, []

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        mark = first * _FAR + second * np.uint64(0xC2B2AE3D27D4EB4F)
        _, one, n = np.unique(mark, return_index=True, return_counts=True)
        self.parts.append((first[one], second[one], n))
        if sum(len(p[2]) for p in self.parts) > 2 * self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
        first, second, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((second, first))
        first, second, n = first[order], second[order], n[order]
        head = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(first) else np.zeros(0, np.int64)
        first, second, n = first[head], second[head], np.add.reduceat(n, head) if len(head) else n
        if len(n) > self.most:
            top = np.argpartition(n, len(n) - self.most)[len(n) - self.most :]
            first, second, n = first[top], second[top], n[top]
        self.parts = [(first, second, n)]
        return self.parts[0]
