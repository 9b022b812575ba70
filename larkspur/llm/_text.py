"""Words and hashes of whole Arrow text columns, computed with numpy inside Spark tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Nothing here loops over words
in Python: a column's UTF-8 buffer is looked at as one array of bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)
_ODD1, _ODD2, _ODD3 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * _ODD2
    h ^= h >> U(29)
    h *= _ODD1
    h ^= h >> U(32)
    return h


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed + 1], dtype=U) * _ODD3)[0]


@dataclass
class Words:
    """The words of some texts: byte spans in ``data`` and, for each text, where its words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of length texts + 1: text k has the words first[k] to first[k + 1]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes a step."""
        size = self.end - self.start
        h = mix(size.astype(U) + seeded(seed))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        at, k = np.arange(len(size)), 0
        while len(at):
            left = size[at] - k
            h[at] = mix(h[at] * _ODD3 + (eight[self.start[at] + k] & _TAIL[np.minimum(left, 8)]))
            at, k = at[left > 8], k + 8
        return h

    def starts_of(self, n: int) -> np.ndarray:
        """Indices of the words at which n words of one text begin."""
        last = np.repeat(self.first[1:], self.count)
        return np.flatnonzero(np.arange(len(self.start)) + n <= last)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, *, lower: bool = False) -> Words:
    space = _SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    some = offsets[:-1] < offsets[1:]
    before[offsets[:-1][some]] = True
    after[offsets[1:][some] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 4 << 20, texts: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``texts`` whole texts of about ``most`` bytes: first text, end, their bytes, their offsets."""
    k, n = 0, len(offsets) - 1
    while k < n:
        j = min(k + texts, max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, side="right")) - 1))
        yield k, j, data[offsets[k] : offsets[j]], offsets[k : j + 1] - offsets[k]
        k = j


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts; order counts."""
    return mix((a ^ (a >> U(27))) * _ODD3 + b)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, over text ends too; see Words.starts_of."""
    size, power, done, have = len(h) - n + 1, h, None, 0
    if size <= 0:
        return np.zeros(0, U)
    span = 1
    while span <= n:
        if n & span:
            done, have = (power, span) if done is None else (join_hashes(done[: len(power) - have], power[have:]), have + span)
        if 2 * span <= n:
            power = join_hashes(power[:-span], power[span:])
        span *= 2
    return done[:size]


def give_back() -> None:
    """Hands memory that a task has freed back to the machine: Spark keeps the worker, and the C library what it has freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
