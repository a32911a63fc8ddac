"""Which byte strings occur in which texts: windows of whole texts against anchors, in Arrow batches.

A phrase is looked up by one of its windows, its anchor: as many bytes as the largest power of two within the phrase. Hashes
of all windows of a text are made level by level, each from two of half its size, so a level costs one pass over the
bytes. A bitmap tells in the row which windows may be anchors; what passes is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
MOST = 32  # bytes of an anchor inside rows
CHUNK = 1 << 20  # bytes of text at a time


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of bounded size, or one longer row."""
    start, last = 0, len(offsets) - 1
    while start < last:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    stops = np.cumsum(sizes)
    return data[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)]


def anchor_size(length: int, most: int = 1 << 62) -> int:
    return min(most, 1 << (length.bit_length() - 1))


def window_hashes(data: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the window at each place) for each of ``sizes``, powers of two in rising order."""
    level, size = (data.astype(np.uint64) + np.uint64(1)) * MIX, 1
    for wanted in sizes:
        while size < wanted:
            level = level[: max(0, len(level) - size)] * MIX + level[size:]
            level ^= level >> np.uint64(29)
            size *= 2
        yield size, level


def bits_of(hashes: np.ndarray, least: int = 16, most: int = 26) -> np.ndarray:
    """A bitmap of the hashes' top bits, 32 bits for each hash within bounds (8 KB to 8 MB)."""
    width = min(most, max(least, (32 * len(hashes)).bit_length()))
    bits = np.zeros(1 << width, np.uint8)
    bits[(hashes >> np.uint64(64 - width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap knows."""
    slot = (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def scoped(hashes: np.ndarray, scope: np.ndarray | None, offsets: np.ndarray) -> np.ndarray:
    """Hashes that differ by the scope (such as a package) of their text: a phrase counts in its own only."""
    if scope is None:
        return hashes
    mixed = np.repeat(scope.view(np.uint64) * MIX, np.diff(offsets))[: len(hashes)]
    return (hashes ^ mixed) * MIX


class Matcher:
    """Phrases of a bounded list (scope, bytes), searched for inside the rows."""

    def __init__(self, phrases: list[tuple[int, bytes]], with_scope: bool):
        self.data = np.frombuffer(b"".join(p for _, p in phrases), np.uint8)
        self.sizes = np.array([len(p) for _, p in phrases], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.with_scope = with_scope
        scopes = np.array([s for s, _ in phrases], np.int64)
        kinds = np.array([anchor_size(n, MOST) for n in self.sizes.tolist()], np.int64)
        self.levels = sorted(set(kinds.tolist()))
        self.tables = {}
        offsets = np.append(self.starts, len(self.data))
        for size, hashes in window_hashes(self.data, self.levels):
            own = np.flatnonzero(kinds == size)
            # Of all its windows a phrase takes the one that the fewest phrases have.
            many = self.sizes[own] - size + 1
            at = gather(np.arange(len(self.data)), self.starts[own], many)
            keys = scoped(hashes, scopes if with_scope else None, offsets)[at]
            _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
            phrase = np.repeat(own, many)
            by = np.lexsort((keys, count[which], phrase))
            first = by[np.concatenate([[True], phrase[by[1:]] != phrase[by[:-1]]])]
            order = first[np.argsort(keys[first], kind="stable")]
            self.tables[size] = (keys[order], phrase[order], at[order] - self.starts[phrase[order]], bits_of(keys[order]))

    def find(self, data: np.ndarray, offsets: np.ndarray, scope: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase) of all phrases that occur, each once, in order."""
        found = [np.zeros(0, np.int64)]
        for size, hashes in window_hashes(data, self.levels):
            own, phrase, shift, bits = self.tables[size]
            keys = scoped(hashes, scope if self.with_scope else None, offsets)
            place = passing(bits, keys)
            left = np.searchsorted(own, keys[place], "left")
            many = np.searchsorted(own, keys[place], "right") - left
            place, left, many = place[many > 0], left[many > 0], many[many > 0]
            # An anchor that many phrases share is compared in bounded pieces.
            cuts = np.searchsorted(np.cumsum(many), np.arange(CHUNK, int(many.sum()), CHUNK))
            for part in np.split(np.arange(len(place)), np.unique(cuts)):
                if not len(part):
                    continue
                entry = gather(np.arange(len(own)), left[part], many[part])
                k = phrase[entry]
                start = np.repeat(place[part], many[part]) - shift[entry]
                row = np.searchsorted(offsets, start, "right") - 1
                inside = (start >= 0) & (row >= 0) & (row < len(offsets) - 1)
                inside[inside] &= start[inside] + self.sizes[k[inside]] <= offsets[row[inside] + 1]
                k, start, row = k[inside], start[inside], row[inside]
                if len(k):
                    # One place of each row and phrase that is equal is enough.
                    same = self._equal(data, start, k)
                    found.append(np.unique(row[same] * len(self.sizes) + k[same]))
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.sizes)), both % max(1, len(self.sizes))

    def _equal(self, data: np.ndarray, start: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        out = np.ones(len(start), bool)
        total = np.cumsum(self.sizes[phrase])
        cuts = np.searchsorted(total, np.arange(CHUNK, int(total[-1]), CHUNK), "right")
        for part in np.split(np.arange(len(start)), np.unique(cuts)):
            if len(part):
                size = self.sizes[phrase[part]]
                other = gather(data, start[part], size) != gather(self.data, self.starts[phrase[part]], size)
                out[part] = ~np.logical_or.reduceat(other, np.cumsum(size) - size)
        return out
