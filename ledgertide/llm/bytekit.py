"""Vectorised helpers over the UTF-8 bytes of an Arrow batch.

Everything here works on one bounded slice of a batch at a time (``slices``), so
that temporary arrays stay a small multiple of ``SLICE_BYTES`` whatever the size
of a partition.  Equal strings have equal hashes on every machine and in every batch.

Polynomial hashes are modulo 2**64 over a fixed random byte table.  Long strings of a
special structure (Thue-Morse words of 1,024 bytes and more) collide under them, so
they only choose candidates that are compared afterwards; what decides by itself takes
``word_hashes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: The multiplier of a second, independent hash.
OTHER_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
_fold = np.arange(256)
_fold[65:91] += 32
#: The same table, but A-Z count as a-z.
FOLDED_VALUES = BYTE_VALUES[_fold]
FOLD = _fold.astype(np.uint8)


def byte_class(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """A boolean table of 256: the bytes in the inclusive ranges (or all others)."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return ~table if inverse else table


#: Words of the contracts: runs of anything but ASCII white space.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), inverse=True)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.empty(size, _U)
        out[0] = 1
        done = 1
        while done < size:  # doubling
            out[done : 2 * done] = out[:done] * _U(pow(base, done, 1 << 64))
            done *= 2
        have = _powers[base] = out
    return have[:n]


@dataclass
class Slice:
    """Some consecutive rows of a batch: their bytes end to end."""

    rows: slice
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows; from 0

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts (null: empty) in runs of about ``limit`` bytes, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    if not n:
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, array.offset * 8)
    values = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        lo, hi = offsets[at], offsets[end]
        yield Slice(slice(at, end), values[lo:hi], offsets[at : end + 1] - lo)
        at = end


def prefix_hashes(data: np.ndarray, table: np.ndarray = BYTE_VALUES, base: int = _BASE) -> np.ndarray:
    """n + 1 prefix sums of table[byte] * base**position."""
    out = np.empty(len(data) + 1, _U)
    out[0] = 0
    terms = table[data]
    terms *= powers(base, len(data))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A well mixed 64-bit hash of each span's bytes, wherever the span stands."""
    raw = (prefix[ends] - prefix[starts]) * powers(pow(base, -1, 1 << 64), len(prefix))[starts]
    return mix(raw + (ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def runs(piece: Slice, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes, which never cross texts, and
    for each text the index of its first run (one more entry at the end)."""
    inside = member[piece.data]
    n = len(inside)
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        borders = piece.offsets[:-1]
        before[borders[borders < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        borders = piece.offsets[1:]
        after[borders[borders > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, piece.offsets)


def word_sums(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of a pseudo-random number for each byte at its place in its word."""
    place = np.arange(len(data))
    if len(starts):
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(mix((place.astype(_U) << _U(8) | data) + _U(0xA0761D6478BD642F)), out=sums[1:])
    return sums


def summed_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, or of their first bytes, from ``word_sums``."""
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(_U) * _U(0xC2B2AE3D27D4EB4F))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tabulation hashes of the bytes of each span (in order, apart from each other): the sum of
    a pseudo-random number for each byte at its place.  Two different spans differ in a number
    that is independent of the others, so they collide with a chance of 2**-64, whatever
    their structure."""
    return summed_hashes(word_sums(data, starts), starts, ends)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes (len(words) - n + 1 of them)."""
    count = max(0, len(words) - n + 1)
    total = np.full(count, n, _U)
    for k in range(n):
        total += words[k : k + count] * _U(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64))
    return mix(total)


def span_texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans' bytes as strings; spans must not cut a character."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.string())
