"""Words of whole texts as numpy arrays over one Arrow column: what the word-level operators of this folder share.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. No UTF-8 character holds one of
these bytes inside, so bytes and characters give the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_HASH_BASE = 0xD1342543DE82EF95
_BYTE = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many consecutive integers from each start, end to end."""
    which = np.repeat(np.arange(len(counts)), counts)
    return starts[which] + np.arange(len(which)) - (np.cumsum(counts) - counts)[which]


def cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte strings of these places as an Arrow array."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    held = data[ranges(starts, sizes)] if len(sizes) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])


@dataclass
class Words:
    """The words of some texts: byte range and text of each word, and where the words of each text begin."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> "Words":
        """Words of a string or binary column; NULL has none."""
        data, offsets = bytes_of(texts)
        space = _IS_SPACE[data]
        word = ~space
        before = np.concatenate(([True], space[:-1]))
        after = np.concatenate((space[1:], [True]))
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before[inner] = True
        after[inner[inner > 0] - 1] = True
        start, end = np.flatnonzero(word & before[: len(word)]), np.flatnonzero(word & after[: len(word)]) + 1
        first = np.searchsorted(start, offsets)
        return Words(data, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word."""
        _Powers.to(len(self.data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data] * _Powers.down[: len(self.data)])))
        return mix((sums[self.end] - sums[self.start]) * _Powers.up[self.start] + (self.end - self.start).astype(np.uint64))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of each text with one space between them: all bytes, and the offset of each text (and the end)."""
        sizes = self.end - self.start
        last = np.append(self.doc[1:] != self.doc[:-1], True)[: len(sizes)]
        ends = np.cumsum(sizes + ~last)
        data = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        data[ranges(ends - sizes - ~last, sizes)] = self.data[ranges(self.start, sizes)]
        return data, np.concatenate(([0], ends))[self.first]

    def distinct(self) -> np.ndarray:
        """A number for each word, equal for equal words only (their bytes are compared, not hashes of them)."""
        codes = cut(self.data, self.start, self.end - self.start).dictionary_encode().indices
        return codes.to_numpy(zero_copy_only=False).astype(np.int64)


class _Powers:
    """Powers of the hash base and of its inverse, kept up to the longest text asked for."""
    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up, cls.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(step)))))
                                for step in (_HASH_BASE, pow(_HASH_BASE, -1, 1 << 64)))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the offset at which each row begins (and the last ends)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string()).view(pa.large_binary())
    else:
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]
