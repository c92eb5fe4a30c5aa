"""Operator 10, suffix-array dedup of repeated passages of ``length`` bytes.

1. Every window of ``length`` bytes picks the smallest hash among its inner grams of half
   that length (leftmost on ties): its anchor.  The choice depends on the window's bytes
   alone, so equal windows have equal anchors at equal offsets, and a text has about one
   anchor in a hundred bytes.  Stretches that repeat themselves are known in the same pass.
2. Equal texts become one class.  The anchors of all classes are counted by their hash;
   those that occur twice or more carry on, with the bytes that their windows span.
3. All occurrences of an anchor meet in one place and their suffixes are sorted: mergesort
   whose comparisons find the common extension by binary search over prefix polynomial
   hashes.  Windows at offset o are equal if a run of neighbours has extensions of
   length - o bytes to the right and the o bytes to the left have one hash; claimed
   matches are then compared byte by byte.  Where a hash has misled, the groups at hand
   are judged by their bytes alone.
4. An anchor with more than ``most`` occurrences is dealt anew before it is sorted: by
   offset in cells of some width, and by the bytes that all windows of a cell have in
   common.  Occurrences with the same bytes around them (by their digest) match and go on
   as one.  Cells that are still crowded become narrower; in the narrowest a window is its
   own key, so every group that is sorted is bounded, however common a passage is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import _BASE, BYTE_VALUES, Slice, mix, powers, prefix_hashes, slices
from ledgertide.llm.filters import FILTER_BITS, frequency_filters, holds
from ledgertide.llm.shared import Scratch, group_starts, grouped, table

LENGTH = 400
#: Occurrences of an anchor that are sorted in one place.
MOST = 2_000
#: Widths of the cells, in offsets, by which more are dealt.
CELLS = (32, 4, 1)
ANCHOR = np.dtype([("gram", "<u8"), ("pos", "<u4"), ("lo", "<u2"), ("hi", "<u2")])
_U = np.uint64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sliding_least(order: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """The smallest of order[s : s + width] for each start."""
    full = np.full(-(-len(order) // width) * width, np.iinfo(_U).max, _U)
    full[: len(order)] = order
    blocks = full.reshape(-1, width)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[starts]
    return np.minimum(behind, np.minimum.accumulate(blocks, axis=1).ravel()[starts + width - 1])


def anchors(piece: Slice, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its anchors (hash of the gram, its place, and the least and greatest
    distance back to the windows that picked it) and its own repeats (begin, end).

    Where the smallest hash stands several times in a window, the first or last is picked,
    the one with the longer stretch outside.  Windows inside a stretch that repeats itself
    with a period equal those one period before; they are known as repeats at once and
    their anchor is left out: equal windows at the stretch's beginning stand for it.
    """
    gram = 3 * length // 8
    width = length - gram + 1
    n = len(piece.data)
    sizes = np.diff(piece.offsets)
    none = np.zeros(0, ANCHOR), np.zeros((0, 2), np.int64)
    if n < length or sizes.max() < length:
        return [none] * len(piece)
    prefix = prefix_hashes(piece.data)
    grams = mix((prefix[gram:] - prefix[:-gram]) * powers(_INVERSE, n + 1)[: n - gram + 1])
    rel = (np.arange(len(grams)) - np.repeat(piece.offsets[:-1], sizes)[: len(grams)]).astype(_U)
    high, low = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)
    starts_of = [np.arange(a, a + s - length + 1) for a, s in zip(piece.offsets, sizes, strict=False) if s >= length]
    starts = np.concatenate(starts_of)
    text = np.repeat(np.flatnonzero(sizes >= length), [len(s) for s in starts_of])
    since = starts - piece.offsets[text]
    left = (_sliding_least((grams & high) | rel, width, starts) & low).astype(np.int64)
    right = (low - (_sliding_least((grams & high) | (low - rel), width, starts) & low)).astype(np.int64)
    picked = np.where(left - since > since + width - 1 - right, left, right) + piece.offsets[text]
    first = group_starts([picked, text])
    last = np.append(first[1:], len(picked)) - 1
    at, begin, stop, owner = picked[first], starts[first], starts[last], text[first]
    # the period that a gram's places in a text suggest: their smallest distance
    order = np.lexsort((at, grams[at], owner))
    same = (grams[at][order][1:] == grams[at][order][:-1]) & (owner[order][1:] == owner[order][:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    gaps = np.full(group[-1] + 1, n)
    apart = np.diff(at[order])
    np.minimum.at(gaps, group[1:][same & (apart > 0)], apart[same & (apart > 0)])
    period = np.empty(len(at), np.int64)
    period[order] = gaps[group]
    own: list[list[tuple[int, int]]] = [[] for _ in range(len(piece))]
    keep = np.ones(len(at), bool)
    raw = piece.data
    for i in np.flatnonzero(period < gram).tolist():
        d, base = int(period[i]), int(piece.offsets[owner[i]])
        a, b = int(begin[i]) - d, int(stop[i]) + length
        if a >= base and np.array_equal(raw[a : b - d], raw[a + d : b]):
            own[owner[i]].append((a - base, b - base))
            keep[i] = False
    at, begin, stop, owner = at[keep], begin[keep], stop[keep], owner[keep]
    out = np.zeros(len(at), ANCHOR)
    out["pos"], out["gram"] = at - piece.offsets[owner], grams[at]
    out["lo"], out["hi"] = at - stop, at - begin
    cuts = np.searchsorted(owner, np.arange(len(piece) + 1))
    return [(out[a:b], np.array(merge_spans(o), np.int64).reshape(-1, 2)) for a, b, o in zip(cuts[:-1], cuts[1:], own, strict=True)]


class Suffixes:
    """Occurrences of anchors with their surroundings, end to end in one byte array."""

    def __init__(self, contexts: list[bytes], before: np.ndarray):
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.array([len(c) for c in contexts])
        begins = np.cumsum(sizes) - sizes
        self.at = begins + before  # of the anchors
        self.before = before
        self.room = sizes - before  # bytes from there on
        # exponents count from each context's own beginning, so that the tables of powers stay small
        top = int(sizes.max(initial=0)) + 1
        self.scale = powers(_INVERSE, top)
        self.prefix = np.zeros(len(self.data) + 1, _U)
        terms = BYTE_VALUES[self.data]
        terms *= powers(_BASE, top)[np.arange(len(self.data)) - np.repeat(begins, sizes)]
        np.cumsum(terms, out=self.prefix[1:])

    def hashes(self, i: np.ndarray, back: np.ndarray | int, lengths: np.ndarray) -> np.ndarray:
        """Of the lengths bytes from back bytes before anchor i."""
        starts = self.at[i] - back
        return (self.prefix[starts + lengths] - self.prefix[starts]) * self.scale[self.before[i] - back]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at anchors i and j, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.room[i], self.room[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self.hashes(i, 0, middle) == self.hashes(j, 0, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def precedes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j (shorter first, then by index)."""
        common = self.extension(i, j)
        end_i, end_j = common == self.room[i], common == self.room[j]
        a = self.data[np.where(end_i, 0, self.at[i] + common)]
        b = self.data[np.where(end_j, 0, self.at[j] + common)]
        return np.where(end_i & end_j, i < j, np.where(end_i, True, np.where(end_j, False, a < b)))

    def order(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes inside each run of equal group, all groups at once."""
        n = len(group)
        order = np.arange(n)
        starts = group_starts([group])
        sizes = np.diff(np.append(starts, n))
        base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        inner = np.arange(n) - base
        width = 1
        while width < sizes.max(initial=0):
            run = inner // width
            other = base + (run ^ 1) * width
            stop = np.minimum(other + width, base + size)
            live = np.flatnonzero(other < stop)
            low, high = other[live].copy(), stop[live].copy()
            while True:
                go = np.flatnonzero(low < high)
                if not len(go):
                    break
                middle = (low[go] + high[go]) // 2
                less = self.precedes(order[middle], order[live[go]])
                low[go] = np.where(less, middle + 1, low[go])
                high[go] = np.where(less, high[go], middle)
            place = np.arange(n)
            place[live] = base[live] + (run[live] // 2) * 2 * width + (inner[live] - run[live] * width) + (low - other[live])
            new = np.empty(n, np.int64)
            new[place] = order
            order = new
            width *= 2
        return order


class Collision(Exception):
    """Two different strings have the same polynomial hash."""


def matched_offsets(contexts: list[bytes], before: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the least and greatest offset o in lo..hi whose window, which
    begins o bytes before the anchor, equals another's of its group (-1: none does)."""
    try:
        return _by_suffixes(contexts, before, group, lo, hi, length)
    except Collision:
        return _by_bytes(contexts, before, group, lo, hi, length)


def _by_bytes(contexts: list[bytes], before: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``matched_offsets`` without any hash of ours, one offset of one group at a time."""
    least, most = np.full(len(contexts), -1), np.full(len(contexts), -1)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        for o in range(int(lo[own].min()), int(hi[own].max()) + 1):
            alike: dict[bytes, list[int]] = {}
            for i in own[(lo[own] <= o) & (o <= hi[own])].tolist():
                at = int(before[i]) - o
                alike.setdefault(contexts[i][at : at + length], []).append(i)
            for rows in alike.values():
                if len(rows) > 1:
                    most[rows] = o
                    least[rows] = np.where(least[rows] < 0, o, least[rows])
    return least, most


def _by_suffixes(contexts: list[bytes], before: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(contexts)
    suffixes = Suffixes(contexts, before)
    order = suffixes.order(group)
    g, lo, hi = group[order], lo[order], hi[order]
    common = np.zeros(n, np.int64)  # with the suffix before
    if n > 1:
        same = np.flatnonzero(g[1:] == g[:-1])
        common[same + 1] = suffixes.extension(order[same], order[same + 1])
        _confirm(suffixes, order[same], order[same + 1], np.zeros(len(same), np.int64), common[same + 1])
    dense = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
    least, most = np.full(n, -1), np.full(n, -1)
    for found, offsets, own in ((most, range(int(hi.max(initial=-1)), -1, -1), lambda o: hi >= o), (least, range(0, int(hi.max(initial=-1)) + 1), lambda o: lo <= o)):
        for o in offsets:
            wanting = (found < 0) & (lo <= o) & (hi >= o)
            if found is least:
                wanting &= most >= o  # others have no match at all
            if not wanting.any():
                if not ((found < 0) & (lo <= hi)).any():
                    break
                continue
            active = np.zeros(dense[-1] + 1, bool)
            active[dense[wanting]] = True
            rows = np.flatnonzero(active[dense])
            # runs of neighbours with length - o bytes in common; rows without this offset still join them
            run = np.cumsum(np.concatenate([[0], ~((common[rows[1:]] >= length - o) & (dense[rows[1:]] == dense[rows[:-1]]))]))
            fit = (lo[rows] <= o) & (hi[rows] >= o)
            rows, run = rows[fit], run[fit]
            left = suffixes.hashes(order[rows], o, np.full(len(rows), o))
            key = mix(left + run.astype(_U) * _U(0x9E3779B97F4A7C15))
            by = np.argsort(key, kind="stable")
            twin = np.flatnonzero((key[by][1:] == key[by][:-1]) & (run[by][1:] == run[by][:-1]))
            a, b = rows[by[twin]], rows[by[twin + 1]]
            _confirm(suffixes, order[a], order[b], np.full(len(a), o), np.full(len(a), 0))
            hit = np.zeros(n, bool)
            hit[a] = hit[b] = True
            found[hit & wanting] = o
    out = np.empty((2, n), np.int64)
    out[0, order], out[1, order] = least, most
    return out[0], out[1]


def _confirm(suffixes: Suffixes, i: np.ndarray, j: np.ndarray, back: np.ndarray, ahead: np.ndarray, chunk: int = 4096) -> None:
    """Compares back bytes before and ahead bytes after the anchors i and j."""
    for at in range(0, len(i), chunk):
        part = slice(at, at + chunk)
        size = back[part] + ahead[part]
        if not size.sum():
            continue
        steps = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        a = np.repeat(suffixes.at[i[part]] - back[part], size) + steps
        b = np.repeat(suffixes.at[j[part]] - back[part], size) + steps
        if not np.array_equal(suffixes.data[a], suffixes.data[b]):
            raise Collision


def repeated_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, spans (array of start, end: the removed runs of
    bytes), sha256 (of the text) and kept_sha256 (of what stays), a row for each row.

    A byte goes if some ``length``-byte string that covers it starts anywhere else too, in
    the same text or another; strings never cross texts and are judged on the input.  All
    occurrences go.  Null and empty texts have no bytes; equal texts repeat as a whole.  Rows are judged one by one, also
    where doc_ids repeat or are null.  Other columns are ignored, whatever their names; an empty
    table gives one.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1), 1 << 20):
                found = anchors(piece, length)
                digests = [hashlib.sha256(piece.bytes_of(i)).hexdigest() for i in range(len(piece))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.rows.start, len(piece)), pa.array(np.diff(piece.offsets)), pa.array(digests), pa.array([x.tobytes() if len(x) else None for x, _ in found], pa.binary()), pa.array([o.tobytes() if len(o) else None for _, o in found], pa.binary())],
                    ["doc_id", "n_bytes", "sha256", "anchors", "own"],
                )

    rows = scratch.save(docs.mapInArrow(scan, f"doc_id {doc_type}, n_bytes long, sha256 string, anchors binary, own binary"), "rows")
    classes = rows.where("anchors IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"), F.first("own").alias("own"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), ANCHOR) for x in batch.column(1)]
            flat = np.concatenate(own) if own else np.zeros(0, ANCHOR)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
            yield pa.RecordBatch.from_arrays([pa.array(flat["gram"].view(np.int64)), node, *(pa.array(flat[c].astype(t)) for c, t in (("pos", np.int64), ("lo", np.int32), ("hi", np.int32)))], ["gram", "node", "pos", "lo", "hi"])

    all_anchors = classes.select("node", "anchors").mapInArrow(spread, "gram long, node long, pos long, lo int, hi int")
    repeated = scratch.save(all_anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    held = all_anchors.join(repeated.select("gram"), "gram").groupBy("node").agg(F.collect_list(F.struct("gram", "pos", "lo", "hi")).alias("held"))
    held = scratch.save(held, "held")
    able = classes.select("node", "rep", "sha256", "own").join(held, "node", "left").where("held IS NOT NULL OR own IS NOT NULL")
    able = scratch.save(able, "able")
    scratch.drop("held")

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the texts that their row means, where doc_ids repeat."""
        for batch in batches:
            right = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() == s.as_py() for t, s in zip(batch.column("text"), batch.column("sha256"), strict=True)]
            yield batch.select(["node", "text", "own", "held"]).filter(pa.array(right, pa.bool_()))

    held_type = "array<struct<gram: bigint, pos: bigint, lo: int, hi: int>>"
    texts = docs.join(able, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text", "own", "held", "sha256")
    texts = scratch.save(texts.mapInArrow(owned, f"node long, text string, own binary, held {held_type}"), "texts")
    scratch.drop("able")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0)
            for piece in slices(batch.column(1), 1 << 20):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i in range(len(piece)):
                    raw = piece.bytes_of(i)
                    node = nodes[piece.rows.start + i].as_py()
                    for x in batch.column("held")[piece.rows.start + i].as_py() or ():
                        pos, lo, hi = x["pos"], x["lo"], x["hi"]
                        for column, value in zip(out, (x["gram"], node, pos, lo, hi, raw[pos - hi : pos - lo + length]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())], ["gram", "node", "pos", "lo", "hi", "context"])

    found = texts.select("node", "text", "held").mapInArrow(occurrences, "gram long, node long, pos long, lo int, hi int, context binary")

    crowded = scratch.save(repeated.where(F.col("n") > most).select("gram"), "crowded")
    any_crowded = not crowded.isEmpty()
    normal = found.join(crowded, "gram", "left_anti") if any_crowded else found

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["gram"], 6000):
            starts = group_starts([part["gram"].to_numpy()])
            sizes = np.diff(np.append(starts, part.num_rows))
            part = part.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if not part.num_rows:
                continue
            gram, lo, hi = part["gram"].to_numpy(), part["lo"].to_numpy().astype(np.int64), part["hi"].to_numpy().astype(np.int64)
            least, farthest = matched_offsets(part["context"].to_pylist(), hi, gram, lo, hi, length)
            ok = least >= 0
            pos = part["pos"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(part["node"].to_numpy()[ok]), pa.array((pos - farthest)[ok]), pa.array((pos - least)[ok] + length)], ["node", "begin", "stop"])

    sort_suffixes = lambda rows: rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(search, "node long, begin long, stop long")
    spans = sort_suffixes(normal)
    if any_crowded:
        crowd = found.join(crowded, "gram", "left_semi")
        for width in (w for w in CELLS if w <= length):  # a cell's windows must share bytes
            alike, few, crowd = dealt_anew(crowd, width, length, most, scratch)
            spans = spans.union(alike).union(sort_suffixes(few))
            if crowd is None:
                break
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    spans = scratch.save(spans, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, kept = [], []
            for text, found, own in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("own").to_pylist(), strict=True):
                local = np.frombuffer(own or b"", np.int64).reshape(-1, 2).tolist()
                runs = merge_spans([(s["begin"], s["stop"]) for s in found or []] + [(a, b) for a, b in local])
                merged.append([{"start": a, "end": b} for a, b in runs])
                kept.append(hashlib.sha256(without(text.as_buffer().to_pybytes(), runs)).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, kind), pa.array(kept, pa.string())], ["node", "spans", "kept"])

    def span_nodes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(batch.column(0).to_numpy().view(_U))

    # texts without any repeat needn't be shuffled to learn that
    touched = spark.sparkContext.broadcast(frequency_filters(spans.select("node"), span_nodes, (0,), min(filter_bits, 24))[0])

    def affected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = holds(touched.value, mix(batch.column(0).to_numpy().view(_U)), min(filter_bits, 24)) > 0
            yield batch.filter(pc.or_(pa.array(hit), batch.column("own").is_valid()))

    affected_texts = texts.select("node", "text", "own").mapInArrow(affected, "node long, text string, own binary")
    some = affected_texts.join(spans, "node", "left").where("own IS NOT NULL OR spans IS NOT NULL").select("node", "text", "spans", "own").mapInArrow(cut, "node long, spans array<struct<start: bigint, end: bigint>>, kept string").dropDuplicates(["node"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    result = classes.select("sha256", "node", "copies", "n_bytes").join(some, "node", "left").select(
        "sha256",
        F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(F.col("copies") > 1, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept")).alias("kept"),
    )
    result = scratch.save(result.where("spans IS NOT NULL"), "result")
    narrow = scratch.save(rows.select("doc_id", "n_bytes", "sha256"), "narrow")
    scratch.drop("rows", "classes", "texts", "spans", "repeated", "crowded", *(f"{x}{w}" for x in ("cells", "sets", "still") for w in CELLS))
    joined = narrow.join(result, "sha256", "left")
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return joined.select("doc_id", "n_bytes", F.coalesce("spans", empty).alias("spans"), "sha256", F.coalesce("kept", "sha256").alias("kept_sha256"))


def cells(batches: Iterator[pa.RecordBatch], width: int, length: int) -> Iterator[pa.RecordBatch]:
    """Each occurrence once for each cell of offsets that it reaches into, under a key made of
    the cell and the bytes that all its windows share, and with a digest of its bytes there."""
    names = ["gram", "node", "pos", "lo", "hi", "context", "d1", "d2"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[tuple] = []
        for gram, node, pos, lo, hi, context in zip(*(batch.column(c).to_pylist() for c in names[:6]), strict=True):
            for cell in range(lo // width, hi // width + 1):
                # offsets count back from the anchor, which stands hi bytes into the context
                least, most = max(lo, cell * width), min(hi, cell * width + width - 1)
                core = context[hi - cell * width : hi - (cell * width + width - 1) + length]
                own = context[hi - most : hi - least + length]
                key = hashlib.blake2b(core, digest_size=8, salt=gram.to_bytes(8, "little", signed=True), person=cell.to_bytes(8, "little")).digest()
                whole = hashlib.blake2b(own, digest_size=16).digest()
                out.append((int.from_bytes(key, "little", signed=True), node, pos, least, most, own, *(int.from_bytes(whole[k : k + 8], "little", signed=True) for k in (0, 8))))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)


def dealt_anew(crowd: DataFrame, width: int, length: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Occurrences of crowded anchors -> the spans of those with the same bytes around them; one
    of each such set (and all others) where no more than ``most`` share a key; the rest."""
    kind = "gram long, node long, pos long, lo int, hi int, context binary, d1 long, d2 long"
    rows = scratch.save(crowd.mapInArrow(lambda it: cells(it, width, length), kind), f"cells{width}")
    same = ["gram", "lo", "hi", "d1", "d2"]
    sets = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "pos")).alias("one"))
    sets = scratch.save(sets, f"sets{width}")
    alike = rows.join(sets.where("n > 1").select(*same), same).select("node", (F.col("pos") - F.col("hi")).alias("begin"), (F.col("pos") - F.col("lo") + length).alias("stop"))
    ones = rows.join(sets.select(*same, "one.node", "one.pos"), [*same, "node", "pos"]).select("gram", "node", "pos", "lo", "hi", "context").dropDuplicates(["gram", "node", "pos", "lo", "hi"])
    still = scratch.save(sets.groupBy("gram").count().where(F.col("count") > most).select("gram"), f"still{width}")
    if width == 1 or still.isEmpty():  # a window of its own key has no other in its group
        return alike, ones, None
    return alike, ones.join(still, "gram", "left_anti"), ones.join(still, "gram", "left_semi")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text: the texts without the bytes that repeated_spans names.  Where a cut
    parts a character, its broken bytes become U+FFFD."""
    spans = repeated_spans(docs, length).select("doc_id", "sha256", "spans").distinct()
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("sha"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t.as_buffer().to_pybytes() if t.is_valid else b"", [(s["start"], s["end"]) for s in own]).decode("utf-8", "replace") for t, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return keyed.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("sha256"))).select("id", "text", "spans").mapInArrow(cut, f"doc_id {doc_type}, text string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
