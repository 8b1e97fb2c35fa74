"""numpy kernels over many texts at once: byte buffers of Arrow columns, word bounds, word hashes, shingles."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that one kernel call works on, unless a single text is longer.
CHUNK = 2 << 20
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def give_back() -> None:
    """Freed memory goes back to the system: a worker that is used again would else keep it between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        both = []
        for b in (_BASE, _BASE_INV):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[:] = both
    return _powers[0], _powers[1]


@dataclass
class Texts:
    """Texts i = buf[lo[i]:hi[i]], one after the other; rows are their places in the batch."""

    rows: np.ndarray
    buf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def texts(column: pa.Array, chunk: int = CHUNK) -> Iterator[Texts]:
    """The texts of a binary or string column in groups of about chunk bytes, without copies; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + chunk, "right")) - 1)
        to = min(to, n)
        lo, hi = off[at:to] - off[at], off[at + 1 : to + 1] - off[at]
        yield Texts(np.arange(at, to), buf[off[at] : off[to]], lo, hi)
        at = to


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # index of the text of each word
    hash: np.ndarray  # uint64, of the lower-cased bytes
    first: np.ndarray  # index of the first word of each text
    count: np.ndarray


def words(t: Texts) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; they never cross texts."""
    n = len(t.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z.astype(np.uint64), np.zeros(len(t.lo), np.int64), np.zeros(len(t.lo), np.int64))
    low = LOWER[t.buf]
    inside = ~SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[t.lo] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, t.lo)
    count = np.searchsorted(start, t.hi) - first
    return Words(start, end, np.repeat(np.arange(len(t.lo)), count), span_hashes(low, start, end), first, count)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] spans: differences of prefix sums of random byte values times powers."""
    up, down = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(w: Words, size: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles of size words as sorted hashes; with fewer words, the whole sequence as one."""
    h = w.hash
    n = len(h)
    all_ = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        all_ += h[j : j + len(all_)] * _SLOT[j]
    all_ = mix(all_)
    out = []
    for f, c in zip(w.first.tolist(), w.count.tolist()):
        if c >= size:
            out.append(np.unique(all_[f : f + c - size + 1]))
        elif c:
                out.append(mix((h[f : f + c] * _SLOT[:c]).sum(dtype=np.uint64, keepdims=True) + np.array([c], np.uint64) * _SLOT[40]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Keys:
    """Places of 64-bit hashes in a sorted array, found by an index of their upper bits; only the array is pickled."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(26, max(1, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def __reduce__(self):
        return Keys, (self.keys,)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't there."""
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.start[cell], self.start[cell + 1]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == h[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out


class Memo:
    """A two-way hash table from 64-bit hashes to places in a pool; what no longer fits is forgotten and asked for again."""

    def __init__(self, bits: int = 20):
        self.bits = bits
        self.key = np.zeros((2, 1 << bits), np.uint64)
        self.val = np.full((2, 1 << bits), -1, np.int32)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't kept."""
        a, b = self._slots(h)
        v = np.where(self.key[0][a] == h, self.val[0][a], -1)
        miss = np.flatnonzero(v < 0)
        b = b[miss]
        v[miss] = np.where(self.key[1][b] == h[miss], self.val[1][b], -1)
        return v

    def put(self, h: np.ndarray, place: np.ndarray) -> None:
        a, b = self._slots(h)
        free = self.val[0][a] < 0
        self.key[0][a[free]], self.val[0][a[free]] = h[free], place[free]
        lost = self.key[0][a] != h
        self.key[1][b[lost]], self.val[1][b[lost]] = h[lost], place[lost]

    def clear(self) -> None:
        self.val[:] = -1
        self.key[:] = 0
