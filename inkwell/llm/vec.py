"""Vectorised bytes, words and running hashes over Arrow string columns.

Everything here works on a block of whole texts laid end to end in one byte buffer, so
that the cost is a few numpy passes per byte and memory is bounded by the block (or by the
longest single text). Hashes are polynomial prefix sums modulo 2**64 over seeded random
tables, finished by a mixing step; a window's hash is two lookups a part of PART units. A
polynomial modulo a power of two can't tell a Thue-Morse word of 1024 units from its
complement; at PART units it can, and the mixing step between parts keeps it so.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
#: Most units of a window that one polynomial stands for.
PART = 256


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finishing step."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


class Rolling:
    """Hashes of windows of a sequence: ``of(prefix(units), start, end)``."""

    def __init__(self, seed: int):
        base = int(_odd(seed, 3)[2]) & ~7 | 5
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.table = _odd(seed + 1, 256)
        self._up = self._down = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            self._up = np.cumprod(np.r_[U(1), np.full(n - 1, self.base)])
            self._down = np.cumprod(np.r_[U(1), np.full(n - 1, self.inverse)])

    def prefix(self, units: np.ndarray) -> np.ndarray:
        """Prefix sums of bytes (through the random table) or of 64-bit units."""
        self._powers(len(units) + 1)
        out = np.zeros(len(units) + 1, U)
        np.cumsum((self.table[units] if units.dtype == np.uint8 else units) * self._up[: len(units)], out=out[1:])
        return out

    def _part(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self._down[start] + (end - start).astype(U))

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the windows [start, end), part by part."""
        start, end = np.asarray(start), np.asarray(end)
        out = self._part(prefix, start, np.minimum(end, start + PART))
        long = np.flatnonzero(end - start > PART)
        at = start[long] + PART
        while len(long):
            stop = np.minimum(at + PART, end[long])
            out[long] = mix(out[long] * self.base + self._part(prefix, at, stop))
            more = stop < end[long]
            long, at = long[more], stop[more]
        return out

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all windows of ``k`` units, by start."""
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, U)
        if k > PART:
            return self.of(prefix, np.arange(n), np.arange(k, n + k))
        return mix((prefix[k:] - prefix[:n]) * self._down[:n] + U(k))


WORDS, GRAMS, CONTEXT = Rolling(11), Rolling(23), Rolling(37)

#: Word separators: space and U+0009 to U+000D; and, for matching prose, all ASCII but letters and digits.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PROSE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of at most ``most`` bytes, or one longer text: first row, end row, bytes, offsets."""
    if not len(column):
        return
    raw, at = buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each text's first word (with the total at the end)."""
    inside = ~separators[raw]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    before = np.r_[False, inside[:-1]]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False][: len(inside)]
    after[cut - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return WORDS.of(WORDS.prefix(raw), starts, ends)


#: What modules keep for a worker's life, by name: how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def release(own: str = "") -> None:
    """Give memory back at the end of a task: a worker lives on and the next stage has needs of its own.

    That goes for what other operators have kept in this worker, too; ``own`` is kept for the operator's next task.
    """
    for name, forget in KEPT.items():
        if name != own:
            forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in some [start, end)."""
    if not len(start):
        return np.zeros(n, bool)
    return np.cumsum(np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1])[:n] > 0
