"""Vectorised text primitives over Arrow batches.

Everything here works on whole columns: a batch's texts become one array of
code points, words become (start, end) arrays, and hashes come from prefix
sums, so no Python statement runs once per word.  Batches are cut into slices
of bounded characters first, which keeps a worker's memory flat whatever the
batch size; a single longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 19
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_WORD_BASE = U(0xD6E8FEB86659FD93)


def tidy() -> None:
    """Gives free memory back: a worker goes on to other tasks, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the running length of ``column`` passes ``most``."""
    if batch.num_rows == 0:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lens, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]]), strict=True):
        yield batch.slice(int(a), int(b - a))
    tidy()


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(0x10000, dtype=np.uint32)
    word = np.zeros(0x10000, dtype=bool)
    for c in range(0x10000):
        ch = chr(c)
        word[c] = ch.isalnum()
        low = ch.lower()
        if len(low) == 1 and low != ch:
            lower[c] = ord(low)
    return lower, word


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a newline, and where each text starts.

    A null counts as an empty text.
    """
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    lens = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    data = texts.buffers()[2]
    raw = memoryview(data)[int(off[0]) : int(off[-1])] if data is not None else b""
    cps = np.frombuffer(bytes(raw).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, starts


def lowered(cps: np.ndarray) -> np.ndarray:
    lower, _ = _tables()
    return np.where(cps < 0x10000, lower[np.minimum(cps, 0xFFFF)], cps).astype(np.uint32)


def is_word(cps: np.ndarray) -> np.ndarray:
    """Letters and digits; beyond the basic plane, ideographs."""
    _, word = _tables()
    return np.where(cps < 0x10000, word[np.minimum(cps, 0xFFFF)], cps >= 0x20000)


def is_solid(cps: np.ndarray) -> np.ndarray:
    """Anything but tab, newline, form feed, return and space."""
    return ~((cps == 32) | (cps == 9) | (cps == 10) | (cps == 12) | (cps == 13))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


def word_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word, from all its code points."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    lens = ends - starts
    inside = np.repeat(np.arange(len(starts)), lens)
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.arange(int(lens.sum())) - first[inside]
    chars = cps[starts[inside] + at].astype(U) + U(1)
    value = np.add.reduceat(mix(chars) * powers(_BASE, int(lens.max()))[at], first)
    return mix(value + lens.astype(U))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (across texts as well: mask by text)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    inverse = U(pow(int(_WORD_BASE), -1, 1 << 64))
    s = np.concatenate([np.zeros(1, dtype=U), np.cumsum(words * powers(_WORD_BASE, len(words)), dtype=U)])
    return mix((s[k:] - s[:n]) * powers(inverse, n))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start..start+len."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return np.arange(total) + np.repeat(starts - first, lens)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
