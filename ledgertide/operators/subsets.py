"""Which inputs of a transaction can make up an output: subsets whose sum lies in a range, the small ones
first and in the order of their indexes.

Sets of one to three inputs are listed and compared at once.  Larger ones meet in the middle: their
last three members are one of the listed triples, sorted by sum, and a table of the
greatest first index over runs of that order says at once whether any triple fits
behind the other members.  So the work is that of the triples, whatever the number of
subsets, and a search that finds nothing is as short as one that does.

Transactions of few inputs, the most frequent, are searched together: all of one number of
inputs in a batch are one product with the table of their sets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: With more inputs than this triples are too many: sets of up to four (of pairs), or beyond the second
#: bound of two, are searched, and the result says that it was cut.
MOST_FOR_TRIPLES, MOST_FOR_PAIRS = 256, 4096
#: Up to so many inputs a transaction is searched with others of its number, so many sums at a time.
FEW_INPUTS, SUMS_AT_ONCE = 10, 2_000_000


def _combinations(n: int, k: int) -> np.ndarray:
    """All index sets of size k in order, a row each."""
    out = np.arange(n, dtype=np.int32)[:, None]
    for _ in range(k - 1):
        counts = n - 1 - out[:, -1]
        owner = np.repeat(np.arange(len(out)), counts)
        begin = np.cumsum(counts) - counts
        last = np.arange(len(owner)) - begin[owner] + out[owner, -1] + 1
        out = np.hstack([out[owner], last[:, None].astype(np.int32)])
    return out


class _Greatest:
    """The greatest value over any run of an array, by doubling."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of lo..hi-1; -1 for empty runs."""
        out = np.full(len(lo), -1, self.levels[0].dtype)
        level = np.frompyfunc(lambda n: int(n).bit_length() - 1, 1, 1)(np.maximum(hi - lo, 1)).astype(np.int64)
        for k in np.unique(level[hi > lo]):
            at = np.flatnonzero((level == k) & (hi > lo))
            out[at] = np.maximum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << int(k))])
        return out


def subsets(inputs: list[int], low: int, high: int, size: int, most: int) -> tuple[list[list[int]], bool]:
    """At most ``most`` index sets of up to ``size`` inputs whose sum is from low to high; and whether more
    were left out, by ``most`` or because there are too many inputs for larger sets."""
    values = np.array(inputs, np.int64)
    n = len(values)
    tail = 3 if n <= MOST_FOR_TRIPLES else 2 if n <= MOST_FOR_PAIRS else 1
    largest = min(size, n, 2 * tail)
    cut = largest < min(size, n)
    found: list[list[int]] = []
    ends = sums = by_sum = sorted_sums = table = None
    for k in range(1, largest + 1):
        if k <= tail:
            sets = _combinations(n, k)
            total = values[sets].sum(axis=1)
            hits = np.flatnonzero((total >= low) & (total <= high))
            found += sets[hits[: most + 1]].tolist()
        else:
            if ends is None:
                ends = _combinations(n, tail)
                sums = values[ends].sum(axis=1)
                by_sum = np.argsort(sums, kind="stable")
                sorted_sums = sums[by_sum]
                table = _Greatest(ends[by_sum, 0].astype(np.int16))
            heads = _combinations(n, k - tail)
            own = values[heads].sum(axis=1)
            lo, hi = np.searchsorted(sorted_sums, low - own, "left"), np.searchsorted(sorted_sums, high - own, "right")
            for h in np.flatnonzero(table.over(lo, hi) > heads[:, -1]):
                at = by_sum[lo[h] : hi[h]]
                at = np.sort(at[ends[at, 0] > heads[h, -1]])[: most + 1 - len(found)]
                found += [[*heads[h].tolist(), *ends[a].tolist()] for a in at]
                if len(found) > most:
                    break
        if len(found) > most:
            return found[:most], True
    return found, cut


@lru_cache
def _all_sets(n: int, size: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of all sets of up to ``size`` of n inputs, in the order of ``subsets``: membership (sets x n), names, sizes."""
    sets = [s for k in range(1, min(size, n) + 1) for s in _combinations(n, k).tolist()]
    member = np.zeros((len(sets), n), np.int64)
    for i, s in enumerate(sets):
        member[i, s] = 1
    return member, ["|".join(map(str, s)) for s in sets], np.array([len(s) for s in sets], np.int64)


def few_inputs(txs: list[int], inputs: list[list[int]], targets: list[int], tolerance: int, size: int, most: int) -> Iterator[tuple]:
    """``subsets`` of transactions with equally many inputs: tx, subset, n_inputs, excess, truncated of each hit."""
    member, names, sizes = _all_sets(len(inputs[0]), size)
    step = max(1, SUMS_AT_ONCE // max(len(names), 1))
    for at in range(0, len(txs), step):
        excess = np.array(inputs[at : at + step], np.int64) @ member.T - np.array(targets[at : at + step], np.int64)[:, None]
        row, hit = np.nonzero((excess >= 0) & (excess <= tolerance))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        cut = np.bincount(row, minlength=len(excess)) > most
        kept = place < most
        for r, h in zip(row[kept].tolist(), hit[kept].tolist(), strict=True):
            yield txs[at + r], names[h], int(sizes[h]), int(excess[r, h]), bool(cut[r])


def input_subsets(rows: DataFrame, tolerance: int, size: int, most: int) -> DataFrame:
    """(tx, inputs array<long>, target long) -> tx, subset (indexes, '|' between them), n_inputs, excess, truncated: a row
    for each hypothesis, whose sum exceeds the target by 0..tolerance.  ``most`` bounds the report of one
    transaction, as the method has it, and truncated says where it did, or where a transaction has
    too many inputs for sets of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tx", "subset", "n_inputs", "excess", "truncated"]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            few: dict[int, list[tuple]] = defaultdict(list)
            for tx, inputs, target in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if inputs and target is not None and len(inputs) <= FEW_INPUTS and None not in inputs:
                    few[len(inputs)].append((tx, inputs, target))
                elif inputs and target is not None:
                    found, cut = subsets(inputs, target, target + tolerance, size, most)
                    for c in found:
                        for column, value in zip(out, (tx, "|".join(map(str, c)), len(c), sum(inputs[i] for i in c) - target, cut), strict=True):
                            column.append(value)
            for rows_of_n in few.values():
                for hit in few_inputs(*map(list, zip(*rows_of_n, strict=True)), tolerance, size, most):
                    for column, value in zip(out, hit, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names)

    return rows.select("tx", "inputs", "target").mapInArrow(run, "tx long, subset string, n_inputs long, excess long, truncated boolean")
