"""Words and word shingles of Arrow string columns as 64-bit hashes, by whole-array numpy operations.

A word is cut into lanes of eight bytes; each lane is mixed with its place and the word's length by a function that is
far from linear, and the results are added (words of more than LONG bytes: BLAKE2b). Shingles are combined from words. A block holds at most BLOCK bytes of text (or one longer text), so memory is bounded by that
and by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_STEP = 0xD6E8FEB86659FD93
#: Bytes of a word beyond which it is hashed by itself.
LONG = 64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """first[i] .. first[i + 1] are the words of text i: start and end in data (bytes), and hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most BLOCK bytes, or of one row."""
    at = string_buffers(column)[1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1)
        yield a, b
        a = b


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes start .. end of each word."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))  # eight bytes from each place on
    out = mixed(size.astype(U) + U(0x9E3779B97F4A7C15))
    every = np.arange(len(size))
    for k in range(LONG // 8):
        at = every if k == 0 else np.flatnonzero(size > 8 * k)
        if not len(at):
            break
        lane = lanes[start[at] + 8 * k] & _MASKS[np.minimum(size[at] - 8 * k, 8)]
        out[at] += mixed(mixed(lane ^ U((k + 1) * 0xA0761D6478BD642F % (1 << 64))) + size[at].astype(U))
    for i in np.flatnonzero(size > LONG):
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), U)[0]
    return out


#: Every ASCII byte but letters and digits.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words(column: pa.Array, a: int = 0, b: int | None = None, lower: bool = True, blank: np.ndarray = _BLANK) -> Words:
    """The words of rows a .. b, between bytes that are blank; lower folds the letters A-Z."""
    data, at = string_buffers(column)
    at = at[a : (len(column) if b is None else b) + 1]
    data, at = data[at[0] : at[-1]], at - at[0]
    if lower:
        data = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
    n = len(data)
    ink = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.ones(n, bool)
    before[1:] = ~ink[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~ink[1:]
    start = np.flatnonzero(ink & (before | edge[:-1]))
    end = np.flatnonzero(ink & (after | edge[1:])) + 1
    h = word_hashes(data, start, end)
    return Words(data, at, start, end, h, np.searchsorted(start, at))


def grams(w: Words, size: int) -> np.ndarray:
    """The hash of the size words from each word on; 0 where a text has no more as many."""
    out = np.zeros(len(w.hash), U)
    n = len(w.hash) - size + 1
    if n > 0:
        for k in range(size):
            out[:n] += w.hash[k : k + n] * U(pow(_STEP, k + 1, 1 << 64))
        out[:n] = mixed(out[:n])
        last = np.repeat(w.first[1:], np.diff(w.first))
        out[np.arange(len(out)) + size > last] = 0
    return out


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the distinct shingles of each text, ascending. Fewer than size words: the sequence as one."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], U)
    if len(w.hash):
        total = np.zeros(len(w.hash), U)
        for k in range(min(size, len(w.hash))):  # a block may have fewer words than a shingle
            total[: len(w.hash) - k] += w.hash[k:] * U(pow(_STEP, k + 1, 1 << 64))
        long = np.repeat(n >= size, count)
        at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
        out = mixed(total[at])
        for i in np.flatnonzero((n > 0) & (n < size)):
            h = w.hash[w.first[i] : w.first[i + 1]]
            out[first[i]] = mixed((h * np.array([pow(_STEP, k + 1, 1 << 64) for k in range(len(h))], U)).sum(keepdims=True) + U(len(h)))[0]
        del long
    keep = np.ones(len(out), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[first[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[first]
