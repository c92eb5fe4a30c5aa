"""Bitmaps of fixed size that say which 64-bit keys of a whole table are held how often."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgertide.llm.shared import freeing_shuffles, group_starts

KEY_BITS = 40
FILTER_BITS = 27
CHUNK_KEYS = 4_000_000
_U = np.uint64


def holds(filter_bytes: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    """1 where the filter has the key's bit."""
    at = keys >> _U(64 - bits)
    return (filter_bytes[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def frequency_filters(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], more_than: tuple[int, ...], bits: int = FILTER_BITS, fill: float | None = None) -> list[np.ndarray]:
    """For each bound one bitmap of 2**bits, indexed by the first bits of a key: set where
    some key has more than so many occurrences in the table.  Never a bit too few; bits
    too many where keys share their first bits (counts go by the first KEY_BITS).  With
    ``fill`` a key range doubles a bound until it sets at most this share of its bits.

    A task sorts its keys and packs them, each once with its count, as compressed
    differences, so that what is shuffled is a few small arrays per task and key range, also
    where all rows share a key; the driver gets the bitmaps, of fixed size, alone.
    """
    # a range gets about as much as a quarter of one input partition gives
    split = max(8, min(20, (4 * df.rdd.getNumPartitions() - 1).bit_length()))
    low = KEY_BITS - split
    span = bits - split

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held)) >> _U(64 - KEY_BITS)
        first = group_starts([keys])
        often = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        cuts = np.append(np.searchsorted(keys, np.arange(1 << split, dtype=_U) << _U(low)), len(keys))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [(keys[cuts[i] : cuts[i + 1]] & _U((1 << low) - 1), often[cuts[i] : cuts[i + 1]]) for i in some]
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([len(x) for x, _ in parts], pa.int64()), *(pa.array(x, pa.binary()) for x in ([squeezed(np.diff(x, prepend=_U(0))) for x, _ in parts], [squeezed(n) for _, n in parts]))],
            ["bucket", "n", "keys", "counts"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for own in keys_of(batch):
                held.append(own)
                count += len(own)
                if count > CHUNK_KEYS:
                    yield pack(held)
                    held, count = [], 0
        if count:
            yield pack(held)

    def marks(index: np.ndarray) -> bytes:
        out = np.zeros(1 << span, bool)
        out[index] = True
        return np.packbits(out, bitorder="little").tobytes()

    def count(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(unsqueezed(x, n), dtype=np.uint32) for x, n in zip(group.column("keys").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([unsqueezed(x, n) for x, n in zip(group.column("counts").to_pylist(), sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = group_starts([keys])
        often = np.add.reduceat(counts[order].astype(np.int64), starts)
        cell = (keys[starts] >> np.uint32(low - span)).astype(np.int64)

        def over(bound: int) -> np.ndarray:
            own = cell[often > bound]
            while fill is not None and len(own) > fill * (1 << span):
                bound *= 2
                own = cell[often > bound]
            return own

        return pa.table({"bucket": group.column("bucket").slice(0, 1), "marks": pa.array([[marks(over(k)) for k in more_than]], pa.list_(pa.binary()))})

    with freeing_shuffles(df.sparkSession):
        packed = df.mapInArrow(gather, "bucket int, n long, keys binary, counts binary")
        rows = packed.groupBy("bucket").applyInArrow(count, "bucket int, marks array<binary>").collect()
    out = [np.zeros(1 << bits >> 3, np.uint8) for _ in more_than]
    step = 1 << span >> 3
    for r in rows:
        for whole, part in zip(out, r.marks, strict=True):
            whole[r.bucket * step : (r.bucket + 1) * step] = np.frombuffer(part, np.uint8)
    return out
