"""Numpy views of Arrow text columns: bytes, words, hashes of words, n-grams and windows.

All functions work on a block: the UTF-8 bytes of some documents, one after another, with
their offsets. Blocks are cut at documents and hold about BLOCK_BYTES, so that memory
doesn't follow the size of an Arrow batch; one longer document is a block of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SMALL_BLOCK_BYTES = 1 << 18  # where each byte takes many arrays of long integers
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
NGRAM = U64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers(dict):
    """Tables of powers made so far in this process; they don't travel with a task."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def held(operator: str) -> dict:
    """What this process keeps for an operator from task to task. What it kept for another
    goes: a reused Python worker takes the tasks of one stage after those of another."""
    kept = sys.modules.setdefault("llm_held", ModuleType("llm_held")).__dict__.setdefault("kept", {})
    others = [k for k in kept if k != operator]
    for other in others:
        del kept[other]
    if others:
        pa.default_memory_pool().release_unused()
    return kept.setdefault(operator, {})


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes fit in a block."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last
        first = last


def split(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of the blocks of a batch."""
    data, at = flat(batch.column(batch.schema.get_field_index(text)))
    for first, last in blocks(data, at, most):
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16, 0 if have is None else min(2 * len(have), BLOCK_BYTES + 1)), base, U64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of byte * base ** position; any substring's hash is a difference of two."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data), BASE), out=out[1:])
    return out


def substring(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), independent of where they stand; lengths are mixed in."""
    h = (sums[end] - sums[start]) * powers(len(sums), BASE_INV)[start]
    return mix(h + (end - start).astype(U64) * NGRAM)


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that cross no document bound."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    bounds = at[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < n)]
    before[bounds] = False
    after[bounds - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the documents among them."""
    start, end = edges(~SPACE[data], at)
    return start, end, np.searchsorted(start, at)


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a hashed sequence and the positions where they start;
    none crosses a document bound."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g = g * NGRAM + h[k : len(h) - n + 1 + k]
    left = np.zeros(len(h) + 1, np.int64)  # how many units of the document follow
    sizes = np.diff(at)
    left = np.repeat(at[1:], sizes) - np.arange(len(h))
    where = np.flatnonzero(left[: len(g)] >= n)
    return mix(g[where] + U64(n)), where


def owner(at: np.ndarray) -> np.ndarray:
    """The document of each unit."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more, and which of them are not the first."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    every, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    every[order[1:]] = same
    later[order[1:]] = same
    every[order[:-1]] |= same
    return every, later


def covered(where: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` units lie in one of the n-grams that start at ``where``."""
    steps = np.zeros(size + 1, np.int64)
    steps[where] += 1
    steps[where + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums per document."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
