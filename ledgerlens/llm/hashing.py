"""Vectorised hashing of words and byte strings, for batches of whole texts.

Texts are UTF-8 bytes laid end to end. Hashes are polynomials modulo 2**64 over per-byte random values, read off
prefix sums: the hash of any substring is one subtraction and one multiplication.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1_000_000     # bytes of text worked on at once; a longer text is a slice of its own
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORDS = 5             # words in a shingle


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and where each text starts (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of texts with at most ``most`` bytes, or one longer text."""
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
        yield a, b
        a = b


class Powers:
    """Powers of the base and of its inverse, grown when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, SLICE + 1)
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, BASE)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, BASE_INVERSE)))


def prefix_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """``p`` with ``(p[j] - p[i]) * powers.down[i]`` the hash of ``data[i:j]``."""
    powers.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers.up[:len(data)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) texts, in order, and the number of words per text."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    data = LOWER[data]
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    p = prefix_hashes(data, powers)
    hashes = mix((p[end] - p[begin]) * powers.down[begin] + (end - begin).astype(np.uint64))
    per_text = np.diff(np.searchsorted(begin, starts))
    return hashes, per_text


def shingle_sets(column: pa.Array, powers: Powers, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """``(position, sorted distinct shingle hashes)`` of each text; fewer words than a shingle make one of the whole
    sequence, none an empty set."""
    data, starts = text_bytes(column)
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(words)]
    for a, b in slices(starts):
        hashes, per_text = word_hashes(data[starts[a]:starts[b]], starts[a:b + 1] - starts[a], powers)
        first = np.concatenate([[0], np.cumsum(per_text)])
        full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for j in range(words):
            full += hashes[j:len(hashes) - words + 1 + j] * factor[j]
        full = mix(full)
        for i in range(b - a):
            n, f = int(per_text[i]), int(first[i])
            if n >= words:
                s = np.sort(full[f:f + n - words + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield a + i, s[keep]
            elif n:
                part = hashes[f:f + n] * np.array(factor[:n])
                yield a + i, mix(np.array([part.sum() + np.uint64(n)], np.uint64))
            else:
                yield a + i, np.empty(0, np.uint64)
