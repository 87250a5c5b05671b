"""Vectorised work on the UTF-8 bytes of Arrow string columns.

An Arrow string column already is one byte buffer and an array of offsets, so
words, hashes and n-grams come from numpy over the buffer without a Python loop
over characters. White space (space and 0x09-0x0D) and A-Z are single bytes that
never occur inside a longer UTF-8 sequence: byte rules equal code point rules.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = U64(0x9E3779B97F4A7C15)
_BYTE = None
_POW: dict[str, np.ndarray] = {}
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Give what this process holds free back to the system: a worker stays for a minute after its task, with the JVM's next work beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def eased(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, after which the worker gives its free memory back."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return freed


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x + _MULT
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=U64))
    if len(_POW.get("up", ())) < n + 1:
        size = 1 << max(16, int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                _POW[name] = np.multiply.accumulate(steps)
    return _BYTE, _POW["up"], _POW["down"]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each, or of one row that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word offsets of the rows."""
    n = len(raw)
    solid = np.zeros(n + 1, dtype=bool)
    solid[:n] = ~WHITE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    table, up, down = _tables(len(lowered))
    with np.errstate(over="ignore"):
        total = np.zeros(len(lowered) + 1, dtype=U64)
        np.cumsum(table[lowered] * up[: len(lowered)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _MULT)


def windows(words: np.ndarray, w: int) -> np.ndarray:
    """Hashes (63 bits) of all runs of w words, those that cross rows included."""
    n = len(words)
    if n < w:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = words[: n - w + 1].copy()
        for i in range(1, w):
            out = out * _MULT + mix(words[i : n - w + 1 + i] + U64(i))
        return mix(out) >> U64(1)


def row_shingles(words: np.ndarray, bounds: np.ndarray, w: int) -> Iterator[np.ndarray]:
    """Each row's distinct w-word shingles, sorted; with fewer words the whole sequence is one."""
    runs = windows(words, w)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= w:
            yield np.unique(runs[a : b - w + 1])
        elif b > a:
            out = np.full(1, U64(b - a), dtype=U64)
            with np.errstate(over="ignore"):
                for x in words[a:b]:
                    out = mix(out * _MULT + x)
            yield mix(out ^ U64(0x5851F42D4C957F2D)) >> U64(1)
        else:
            yield np.zeros(0, U64)


def shingle_sets(column: pa.Array, w: int) -> Iterator[np.ndarray]:
    """Per row of a text column its set of w-word shingles of A-Z lower-cased text."""
    raw, offsets = buffer_of(column)
    for a, b in pieces(offsets):
        part = LOWER[raw[offsets[a] : offsets[b]]]
        starts, ends, bounds = spans(part, offsets[a : b + 1] - offsets[a])
        yield from row_shingles(word_hashes(part, starts, ends), bounds, w)
