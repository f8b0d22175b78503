"""Byte-level text kernels on Arrow buffers: tokens, hashes and per-document sums without a Python loop per token.

A word is a maximal run of bytes outside ``20`` and ``09-0D``; UTF-8 keeps those bytes for ASCII, so byte and code
point tokenisation agree. Hashes are 64 bits. Texts are taken in slices of about ``SLICE`` bytes, a longer text as a
slice of its own, and hashing works through at most ``BLOCK`` bytes at a time, so that the memory held beside a text
is a small multiple of it.
"""

import ctypes

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def tidy(kernel):
    """``kernel`` (batches to batches) that at its end gives the system back what the allocators of Arrow and the C library keep:
    the worker process lives on beside the executor's JVM, through stages that need no Python."""

    def run(batches):
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits (the finaliser of splitmix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > BLOCK:  # a token longer than a block; not kept
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)])) for p in (_P, _PINV))
    if "up" not in _powers:
        for name, p in (("up", _P), ("down", _PINV)):
            _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, p, np.uint64)]))
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each byte span; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = int(ends[hi - 1]) - base
        up, down = _table(size)
        pre = np.zeros(size + 1, np.uint64)
        np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=pre[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (pre[e] - pre[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)


def strings(column: pa.Array, limit: int = SLICE):
    """Slices of a string column: (first row, end row, bytes, byte offsets of its rows from 0). Nulls read as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a slice: byte spans ``start``/``end``, ``count`` per row, ``first`` word of each row (and the end)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offs = offs
        solid = ~_SPACE[data]
        begins, ends = solid.copy(), solid
        if len(data):
            begins[1:] &= ~solid[:-1]
            inner = offs[(offs > 0) & (offs < len(data))]
            begins[inner] |= solid[inner]
            self.start = np.flatnonzero(begins)
            ends = np.zeros(len(data) + 1, bool)
            ends[1:-1] = solid[:-1] & ~solid[1:]
            ends[-1] = solid[-1]
            ends[inner] |= solid[inner - 1]
            self.end = np.flatnonzero(ends)
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on; the last ``width - 1`` are left out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(acc, width)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``bounds``."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def lists(values: np.ndarray, lengths) -> pa.ListArray:
    """An Arrow list column of the flat ``values``."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))
