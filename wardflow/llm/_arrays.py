"""Vectorised helpers over the bytes of a text column.

Every helper works on the whole UTF-8 buffer of an Arrow batch at once, so
the per-row work inside a task stays in numpy. ``slices`` cuts a batch into
pieces of bounded bytes, which bounds the size of the temporaries (a single
longer text is one piece of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whitespace of the contracts: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: Digits, small letters and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
LONG_WORD = 64
SLICE_BYTES = 2 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another (null: none) and their offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, (_, offs, data) = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold at most ``most`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64)) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = [0, *cuts.tolist(), len(lengths)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true flags that stay inside one text: starts, ends, and
    the offsets of each text's runs."""
    n = len(flags)
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = flags
    edge = offsets[:-1][offsets[:-1] < n]
    prev = before[:-1].copy()
    prev[edge] = False
    starts = np.flatnonzero(flags & ~prev)
    nxt = np.zeros(n, dtype=bool)
    nxt[:-1] = flags[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    nxt[last] = False
    ends = np.flatnonzero(flags & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(32))) * _MIX2
    h = (h ^ (h >> U64(32))) * _MIX2
    return h ^ (h >> U64(32))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight bytes at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    out = lengths.astype(U64) * _MIX1
    live, r = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD)), 0
    while len(live):
        left = lengths[live] - 8 * r
        v = eight[starts[live] + 8 * r]
        short = np.minimum(left, 8).astype(U64) * U64(8)
        v = np.where(left >= 8, v, v & ((U64(1) << (short & U64(63))) - U64(1)))
        h = (out[live] ^ v) * _MIX2
        out[live] = h ^ (h >> U64(29))
        r += 1
        live = live[left > 8]
    for i in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(buf[starts[i]: ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return mix(out)


def hash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * _MIX1 + h[k: k + n]
    return mix(out)


def expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given lengths, laid out one after another: each
    element's group, and its index in the group."""
    lengths = np.asarray(lengths, dtype=np.int64)
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - first[group]


def stable_share(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 64-bit hashes, by their high bits."""
    return ((values >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
