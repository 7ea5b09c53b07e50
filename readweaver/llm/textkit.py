"""Vectorised text primitives shared by the operators of this subpackage.

All functions work on one Arrow batch (or a byte-bounded slice of one) with
numpy; no function keeps state that grows with the corpus.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a batch; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair of hashes, in that order."""
    return splitmix((a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)) ^ b)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most `most` bytes, one row at least."""
    data, offs = utf8(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, the index of its first word (length rows + 1).

    ``gap`` marks the bytes between words, if others than those.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~gap[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = offs[(offs > 0) & (offs < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Ranges of more bytes than this are hashed one by one.
_LONG = 512


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each range: its length and its eight-byte pieces, mixed one after the other.

    Two ranges of eight bytes or fewer and one length never have the same hash.
    """
    size = ends - starts
    out = splitmix(size.astype(np.uint64) + np.uint64(seed << 48 | 1))
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, k = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        piece = eight[at]
        part = left < 8
        piece[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        h = splitmix(h * np.uint64(0x9E3779B97F4A7C15) ^ piece)
        more = left > 8
        out[live[~more]] = h[~more]
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return range_hashes(data, starts, ends)


def gram_hashes(values: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n values from each position on, and whether that run stays in its row.

    Runs of 2, 4, 8, ... values are joined from halves, and n values from the two longest such runs, which may overlap.
    ``first`` is the row index table of `words`.
    """
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out, span = splitmix(values + np.uint64(n)), 1
    while span < n:
        step = min(span, n - span)
        out = join(out[:-step], out[step:])
        span += step
    ok = np.ones(count, bool)
    edges = first[1:-1]
    for k in range(1, n):
        e = edges - k
        ok[e[(e >= 0) & (e < count)]] = False
    return out, ok


def row_of(first: np.ndarray) -> np.ndarray:
    """Row index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values per row, empty rows 0."""
    p = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=p[1:])
    return p[first[1:]] - p[first[:-1]]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks of n positions that lie in [s, s + length) for some s."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0
