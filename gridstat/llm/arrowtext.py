"""Vectorised text kernels that work on the UTF-8 buffers of Arrow string columns.

No Python string is made: a batch of texts is one byte array plus offsets, words
and lines are index ranges of it.  A range's hash mixes each of its 8-byte blocks
non-linearly, with the block's place, and its length: no texts of a regular make
share one, as they can where a hash is a polynomial in the bytes.  Texts made on
purpose can share one under a key that their maker knows, so where a result rests on
equal hashes the key is drawn anew for each run.  Batches are cut into slices of a few
MB first, so that the temporaries stay small whatever the Arrow batch size; only a
single longer text makes a larger slice.
"""

from __future__ import annotations

import ctypes
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = (1 << 20) - 1024
SLICE_ROWS = 4096
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xD6E8FEB86659FD93)
#: The bytes of a block that belong to a range, by their number.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def whitespace_table() -> np.ndarray:
    """Bytes of a word are all but U+0020 and U+0009-000D; separators map to 0, a byte b to b + 1."""
    t = np.arange(1, 257, dtype=np.uint16)
    t[[0x20, *range(0x09, 0x0E)]] = 0
    return t


def alnum_table() -> np.ndarray:
    """Bytes of a word are 0-9, a-z and all beyond ASCII, after A-Z are lower-cased."""
    t = np.zeros(256, np.uint16)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b + 1
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


def trim() -> None:
    """Give freed memory back to the system, as workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def new_key() -> np.uint64:
    """A key that no text's maker knew; it goes to the tasks of one run, so that a repeated task has the same."""
    return U64(secrets.randbits(64))


class Texts:
    """Some consecutive rows' bytes; ``off`` has one more entry than there are rows.  Null is empty."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1


def texts(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of the column of about ``size`` bytes, in row order; ``first`` is the row each begins with."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + size, "right")) - 1
        end = min(max(end, at + 1), n, at + SLICE_ROWS)
        yield Texts(data[off[at] : off[end]], off[at : end + 1] - off[at], at)
        at = end
    trim()


class Words:
    """The words of a slice: start and end bytes, 64-bit hashes, and each row's range of words."""

    def __init__(self, t: Texts, table: np.ndarray, key: np.uint64 = U64(0)):
        inside = (table != 0)[t.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = t.off[1:-1]
        edge = edge[edge < len(inside)]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = edge[edge > 0] - 1
        last[before] = inside[before]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = span_hashes((table - 1).astype(np.uint8)[t.data], self.start, self.end, key)
        self.off = np.searchsorted(self.start, t.off)
        self.row = np.repeat(np.arange(t.n), np.diff(self.off))


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the last one."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def _later_blocks(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The second and further blocks of ranges longer than 8 bytes: range, number and bytes of each, and each range's first one."""
    n = (size - 1) >> 3
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(size)), n)
    k = np.arange(int(n.sum())) - first[own] + 1
    return own, k, np.minimum(size[own] - 8 * k, 8), first


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.uint64 = U64(0)) -> np.ndarray:
    """A 64-bit hash of each range of the bytes under a key; equal ranges have equal hashes wherever they lie."""
    if not len(start):
        return np.empty(0, U64)
    at, size = _windows(data), end - start
    total = mix(((at[start] & _MASK[np.minimum(size, 8)]) ^ key) + _Q)
    long = np.flatnonzero(size > 8)
    if len(long):
        own, k, left, first = _later_blocks(size[long])
        part = mix(mix((at[start[long][own] + 8 * k] & _MASK[left]) ^ key) + k.astype(U64) * _P)
        total[long] += np.add.reduceat(part, first)
    return mix(total + size.astype(U64) * _P)


def same_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each range of ``a`` has the same bytes as the range of this size of ``b``."""
    if not len(size):
        return np.empty(0, bool)
    x, y = _windows(a), _windows(b)
    same = ((x[a_start] ^ y[b_start]) & _MASK[np.minimum(size, 8)]) == 0
    long = np.flatnonzero(size > 8)
    if len(long):
        own, k, left, first = _later_blocks(size[long])
        differ = (x[a_start[long][own] + 8 * k] ^ y[b_start[long][own] + 8 * k]) & _MASK[left]
        same[long] &= np.bitwise_or.reduceat(differ, first) == 0
    return same


def window_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one row, and the index of each one's first word."""
    n = len(w.hash)
    if n < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = np.zeros(n - k + 1, U64)
    for i in range(k):
        h = h * _Q + w.hash[i : n - k + 1 + i]
    at = np.flatnonzero(w.row[: n - k + 1] == w.row[k - 1 :])
    return mix(h[at]), at


def word_hash(word: str, table: np.ndarray) -> int:
    """The hash that ``Words`` gives this one word."""
    d = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes((table - 1).astype(np.uint8)[d], np.array([0]), np.array([len(d)]))[0])
