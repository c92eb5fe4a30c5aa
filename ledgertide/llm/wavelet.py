"""A wavelet matrix over token ids: one compressed, self-contained file per shard.

Level k holds bit (bits - 1 - k) of every id, the ids being stably parted at each level
into those with a 0 and those with a 1.  A plane is cut into blocks that are compressed
one by one, and the directory has each block's place and the number of ones before it,
so that ``access``, ``rank``, ``select``, ``count`` and ``occurrences`` open a few blocks
of each plane only.

Layout (little-endian): MAGIC, then 6 x int64 (version, n_tokens, n_docs, bits,
length of the directory, flags), doc ids (int64), null marks (uint8), document ends
(int64), zeros of each level (int64), the directory (for each level and block: place,
length, ones before; 3 x int64), and the blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVMX0001"
BLOCK_BYTES = 1 << 15
BLOCK_BITS = BLOCK_BYTES * 8


def encode(ids: np.ndarray, doc_ids: list[int | None], doc_ends: np.ndarray, bits: int) -> bytes:
    """The file's bytes. ids: of all documents end to end; doc_ends: where each ends."""
    n = len(ids)
    blocks = -(-n // BLOCK_BITS)
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    one = seq.dtype.type(1)
    press = zstandard.ZstdCompressor(level=1)
    zeros, directory, payload, at = [], np.zeros((bits, blocks, 3), np.int64), [], 0
    for level in range(bits):
        bit = ((seq >> seq.dtype.type(bits - 1 - level)) & one).view(np.bool_ if seq.itemsize == 1 else seq.dtype).astype(bool)
        plane = np.packbits(bit, bitorder="little").tobytes()
        ones = 0
        for b in range(blocks):
            raw = plane[b * BLOCK_BYTES : (b + 1) * BLOCK_BYTES]
            packed = press.compress(raw)
            directory[level, b] = at, len(packed), ones
            payload.append(packed)
            at += len(packed)
            ones += int(np.count_nonzero(bit[b * BLOCK_BITS : (b + 1) * BLOCK_BITS]))
        zeros.append(n - ones)
        seq = np.concatenate([seq[~bit], seq[bit]])
    marks = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = np.array([1, n, len(doc_ids), bits, directory.size, 0], "<i8")
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), marks.tobytes(), np.asarray(doc_ends, "<i8").tobytes(), np.array(zeros, "<i8").tobytes(), directory.astype("<i8").tobytes(), *payload])


class WaveletShard:
    """Reads a file made by ``encode``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        _, self.n, docs, self.bits, size, _ = (int(x) for x in np.frombuffer(data, "<i8", 6, 8))
        at = 56
        keys = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        marks = np.frombuffer(data, np.uint8, docs, at)
        at += docs
        self.doc_ids = [None if m else int(k) for k, m in zip(keys, marks, strict=True)]
        self.doc_ends = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.zeros = np.frombuffer(data, "<i8", self.bits, at)
        at += 8 * self.bits
        self.directory = np.frombuffer(data, "<i8", size, at).reshape(self.bits, -1, 3)
        self.base = at + 8 * size
        self.data = data
        self._block = lru_cache(maxsize=64)(self._unpack)

    def _unpack(self, level: int, block: int) -> np.ndarray:
        place, length, _ = self.directory[level, block]
        raw = zstandard.decompress(self.data[self.base + place : self.base + place + length], max_output_size=BLOCK_BYTES)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").view(bool)

    def plane(self, level: int) -> np.ndarray:
        parts = [self._unpack(level, b) for b in range(self.directory.shape[1])]
        return (np.concatenate(parts) if parts else np.zeros(0, bool))[: self.n]

    def ones_before(self, level: int, i: int) -> int:
        if i <= 0 or not self.n:
            return 0
        if i >= self.n:
            return int(self.n - self.zeros[level])
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.directory[level, block, 2]) + int(np.count_nonzero(self._block(level, block)[:rest]))

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = bool(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self.ones_before(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often token stands before position i."""
        if token >> self.bits:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.bits):
            a, b = self.ones_before(level, lo), self.ones_before(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(token, self.n if hi is None else hi) - self.rank(token, lo)

    def _find(self, level: int, bit: bool, k: int) -> int:
        """The position of the k-th (from 0) such bit of the level."""
        before = self.directory[level, :, 2]
        if not bit:
            before = np.arange(len(before)) * BLOCK_BITS - before
        block = int(np.searchsorted(before, k, "right")) - 1
        inside = np.flatnonzero(self._block(level, block)[: self.n - block * BLOCK_BITS] == bit)
        return block * BLOCK_BITS + int(inside[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of token."""
        if not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        lo = 0
        for level in range(self.bits):
            ones = self.ones_before(level, lo)
            lo = int(self.zeros[level]) + ones if token >> (self.bits - 1 - level) & 1 else lo - ones
        at = lo + k
        for level in reversed(range(self.bits)):
            bit = bool(token >> (self.bits - 1 - level) & 1)
            at = self._find(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane upwards."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = self.plane(level)
            zeros = int(self.zeros[level])
            above = np.empty_like(ids)
            above[~bit] = ids[:zeros]
            above[bit] = ids[zeros:] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = above
        return ids
