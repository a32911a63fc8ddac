"""Texts of an Arrow batch as one byte array, and vectorised words and hashes over it.

Hashes are polynomials with a mixing step; the same bytes give the same hash in every task. Those of `range_hashes`
are modulo 2**64: short strings and sorting only, since unequal strings that collide can be built. Those of
`word_hashes` are modulo two primes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15


def worker_cache() -> dict:
    """What a Python worker keeps between tasks."""
    return sys.modules.setdefault("_caseloom_worker", types.ModuleType("_caseloom_worker")).__dict__


def trim() -> None:
    """Give memory that is free in this worker back to the system: what another operator left is not for it to keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def kept(key, build: Callable):
    """One large object per worker, for all its tasks that ask for the same."""
    cache = worker_cache()
    if cache.get("key") != key:
        cache.pop("object", None)
        trim()
        cache["key"], cache["object"] = key, build()
    return cache["object"]


def release() -> None:
    """Drop what `kept` holds: another operator runs now, and the memory is for it."""
    cache = worker_cache()
    cache.pop("object", None)
    cache.pop("key", None)
    trim()


class Recent(dict):
    """A bounded memory of results: when ``limit`` are held, all but those asked for since are dropped in time."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def find(self, key):
        """For keys that a plain ``get`` missed."""
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, column: str = "text", keep: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): runs of rows with at most ``limit`` bytes of text, or one longer text. Null is empty.
    ``keep`` is for operators that use `kept`."""
    if not keep:
        release()
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
            start = stop


def byte_set(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if len(cache.get("powers", ((),))[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        cache["powers"] = tuple(both)
    return cache["powers"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_404_417_131, 1_861_523_467)
LONG = 1 << 16  # bytes, up to which a word is hashed beside others


def _prime_powers() -> list[np.ndarray]:
    cache = worker_cache()
    if "prime_powers" not in cache:
        rows = []
        for prime, base in zip(PRIMES, BASES, strict=True):
            row = np.ones(LONG, np.uint64)
            done = 1
            while done < LONG:
                row[done : 2 * done] = row[:done] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
                done *= 2
            rows.append(row)
        cache["prime_powers"] = rows
    return cache["prime_powers"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """A hash of each data[start:end], none empty: polynomials modulo two primes, joined to 62 bits and mixed."""
    size, both, powers = ends - starts, np.zeros((2, len(starts)), np.uint64), _prime_powers()
    short = np.flatnonzero(size <= LONG)
    total = np.cumsum(size[short])
    cuts = np.searchsorted(total, np.arange(step, total[-1] if len(total) else 0, step), "right")
    for part in np.split(short, np.unique(cuts)) if len(short) else []:
        if not len(part):
            continue
        n = size[part]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        value = data[place + np.repeat(starts[part], n)].astype(np.uint64) + np.uint64(1)
        for k, prime in enumerate(PRIMES):
            both[k, part] = np.add.reduceat(value * powers[k][place], begin) % np.uint64(prime)
    for i in np.flatnonzero(size > LONG).tolist():
        for k, prime in enumerate(PRIMES):
            found, shift, jump = 0, 1, pow(BASES[k], LONG, prime)
            for at in range(int(starts[i]), int(ends[i]), LONG):
                value = data[at : min(at + LONG, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                found = (found + shift * (int(np.sum(value * powers[k][: len(value)], dtype=np.uint64)) % prime)) % prime
                shift = shift * jump % prime
            both[k, i] = found
    return mix(both[0] << np.uint64(31) | both[1])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """data[start:end] of all ranges, one after the other."""
    size = ends - starts
    stops = np.cumsum(size)
    return data[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - size), size)]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes in ``inside``; no run crosses texts."""
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    begin, end = offsets[:-1], offsets[1:]
    full = end > begin
    first[begin[full]] = mask[begin[full]]
    last[end[full] - 1] = mask[end[full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(BASE) + hashes[j : j + n])
    return out
