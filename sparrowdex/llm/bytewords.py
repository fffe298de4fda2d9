"""Vectorised access to the UTF-8 bytes of an Arrow text column: words, hashes, shingles.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  In UTF-8 these bytes occur only as
themselves, so byte runs and code-point runs are the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise; a bijection."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `limit` bytes (a longer text stands alone).

    Yields (first row, end row, bytes, offsets); nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0:
        return
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def cut(batches: Iterator[pa.RecordBatch], at: int, limit: int = SLICE_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about `limit` bytes of text in column `at` (a longer text stands alone).

    What Python makes of texts is several times their size.
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) + 64)
        lo = 0
        while lo < len(b):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and words before each text's begin (len = texts + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time over all words at once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    size = ends - starts
    h = mix(lanes[starts] & _LANE[np.minimum(size, 8)]) ^ size.astype(np.uint64)
    left = np.flatnonzero(size > 8)
    done = 8
    while len(left) and done < _LONG_WORD:
        s, k = starts[left] + done, np.minimum(size[left] - done, 8)
        h[left] = mix(h[left] ^ mix(lanes[s] & _LANE[k]))
        done += 8
        left = left[size[left] > done]
    for i in left:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles.

    A text of fewer words gives its whole word sequence as one shingle, a text without words none.
    """
    starts, ends, first = word_bounds(data, offs)
    w = word_hashes(LOWER[data], starts, ends)
    if len(w) >= width:
        m = len(w) - width + 1
        acc = mix(w[:m])
        for j in range(1, width):
            acc = mix(acc ^ w[j : m + j])
    else:
        acc = np.zeros(0, np.uint64)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(acc[a : b - width + 1])
        elif b > a:
            one = np.array([0x5851F42D4C957F2D + b - a], np.uint64)
            for j in range(a, b):
                one = mix(one ^ w[j : j + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted hash set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
