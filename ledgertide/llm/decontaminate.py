"""Operator 4, benchmark decontamination by templates.

Numbers, units and names become typed placeholders, so that a question asked again with
other values has the same template.  Windows of template tokens are hashed; a document's
windows pass a bitmap of fixed size made from the benchmark's, and the survivors meet
them in a hash join on the whole hash.  Along one diagonal (place in the document less
place in the item) each of the item's slot values stands for one value of the document,
the one that most windows give it; windows that have another are dropped, the rest stay.
An item leaks into a document if the windows that stay cover half of the item's or more.
The tokens of windows with one hash are compared too.  Items of which a template says too
little (no window has ``LITERALS`` plain words) must be there with their own values, and
items of fewer tokens than that must be the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, FOLDED_VALUES, Slice, byte_class, ngram_hashes, prefix_hashes, runs, slices, span_hashes
from ledgertide.llm.filters import frequency_filters, holds
from ledgertide.llm.shared import Scratch, arrow_map, join_small, table

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
FILTER_BITS = 24
TOKEN = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees kmh mph volt volts watt watts"
_PLACEHOLDERS = np.array([0, 0x1F3D5B79A1C3E507, 0x2E4C6A8F0B1D3957, 0x3D5B7988A6C4E213], np.uint64)  # number, unit, name
_U = np.uint64


def _hash_words(words: str) -> np.ndarray:
    return np.sort(np.array([span_hashes(prefix_hashes(np.frombuffer(w.encode(), np.uint8), FOLDED_VALUES), np.array([0]), np.array([len(w)]))[0] for w in words.split()], _U))


def _among(values: np.ndarray, table_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table_, values)
    at[at == len(table_)] = 0
    return table_[at] == values


_NUMBERS, _UNITS = _hash_words(NUMBER_WORDS), _hash_words(UNITS)


def template(piece: Slice) -> tuple[np.ndarray, ...]:
    """Starts, ends, kinds (0 word, 1 number, 2 unit, 3 name) and template hashes of the tokens,
    and the index of each text's first.

    A token with a digit, or a number word, is a number ('.' and ',' inside belong to it);
    a unit follows a number; a name begins with a capital, isn't all capitals, and doesn't
    follow the end of a sentence or the text's or line's beginning.
    """
    data = piece.data
    n = len(data)
    inner = np.zeros(256, bool)
    inner[[0x2E, 0x2C]] = True
    digit = (data >= 0x30) & (data <= 0x39)
    member = TOKEN[data]
    if n > 2:
        member[1:-1] |= inner[data[1:-1]] & digit[:-2] & digit[2:]
    starts, ends, first = runs(Slice(piece.rows, member.view(np.uint8), piece.offsets), np.arange(256) == 1)
    hashes = span_hashes(prefix_hashes(data, FOLDED_VALUES), starts, ends)
    digits = np.concatenate([[0], np.cumsum(digit)])
    capital = (data >= 0x41) & (data <= 0x5A)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    number = (digits[ends] > digits[starts]) | _among(hashes, _NUMBERS)
    unit = np.zeros(len(starts), bool)
    opening = np.ones(len(starts), bool)
    if len(starts):
        unit[1:] = number[:-1] & _among(hashes[1:], _UNITS) & ~number[1:]
        stop = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:\n", np.uint8)))])
        opening[1:] = stop[starts[1:]] > stop[ends[:-1]]
        opening[first[:-1][first[:-1] < len(starts)]] = True
        unit[first[:-1][first[:-1] < len(starts)]] = False
    name = (capital[starts] if len(starts) else opening) & ~opening & (capitals[ends] - capitals[starts] < ends - starts) & ~number & ~unit
    kinds = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    return starts, ends, kinds, np.where(kinds > 0, _PLACEHOLDERS[kinds], hashes), first


def _slots(piece: Slice, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, a: int, b: int) -> list[str]:
    """The values of the placeholders among tokens a..b, with their kinds, in order."""
    return [f"{kinds[k]}:{piece.data[starts[k] : ends[k]].tobytes().decode('utf-8', 'replace').lower()}" for k in range(a, b) if kinds[k]]


def _spelled(piece: Slice, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, a: int, b: int) -> str:
    """The template of tokens a..b: words in lower case, placeholders as their kind."""
    return " ".join(f"<{kinds[k]}>" if kinds[k] else FOLD[piece.data[starts[k] : ends[k]]].tobytes().decode("utf-8", "replace") for k in range(a, b))


def item_windows(benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(item_id, text) -> window (hash), item_id, item_pos, width, n_windows, item_slots, item_template,
    exact (slots must have the item's values), alone (the item must be the whole text).

    Windows with fewer than ``literals`` plain words are left out unless the item has no
    other: then it is exact, and alone if it has fewer than ``literals`` tokens.  An item with
    fewer tokens than ``size`` is one window; one without a token has none.
    """
    item_type = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                starts, ends, kinds, hashes, first = template(piece)
                out: list[tuple] = []
                for i in range(len(piece)):
                    a, b = int(first[i]), int(first[i + 1])
                    width = min(size, b - a)
                    if not width:
                        continue
                    plain = np.convolve(kinds[a:b] == 0, np.ones(width, int), "valid")
                    exact = not (plain >= literals).any()
                    places = np.arange(len(plain)) if exact else np.flatnonzero(plain >= literals)
                    grams = ngram_hashes(hashes[a:b], width).view(np.int64)
                    item = batch.column(0)[piece.rows.start + i].as_py()
                    out += [(int(grams[p]), item, int(p), width, len(places), _slots(piece, starts, ends, kinds, a + p, a + p + width), _spelled(piece, starts, ends, kinds, a + p, a + p + width), exact, exact and b - a < literals) for p in places]
                names = ["window", "item_id", "item_pos", "width", "n_windows", "item_slots", "item_template", "exact", "alone"]
                kinds_ = [pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds_)], names)

    return benchmark.select("item_id", "text").mapInArrow(run, f"window long, item_id {item_type}, item_pos long, width int, n_windows long, item_slots array<string>, item_template string, exact boolean, alone boolean")


def agreeing(windows: list[list[tuple[str, str]]]) -> list[bool]:
    """Of the windows of one diagonal, each a list of slots (item's value, document's value),
    those that agree: each item value has the document value that most windows give it
    (of equals its own, else the smallest).  A window that gives one value two has no vote."""
    votes: dict[str, Counter] = {}
    for slots in windows:
        own = dict(slots)
        if all(own[a] == b for a, b in slots):
            for a, b in own.items():
                votes.setdefault(a, Counter())[b] += 1
    chosen = {a: min(c, key=lambda b: (-c[b], b != a, b)) for a, c in votes.items()}
    return [all(chosen.get(a) == b for a, b in slots) for slots in windows]


def _judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Lines with their windows -> places of the windows that agree, and same: no slot of the
    line has another value."""
    places, same = [], []
    for windows in batch.column(batch.num_columns - 1).to_pylist():
        slots = [[(s["a"], s["b"]) for s in w["slots"]] for w in windows]
        places.append([w["item_pos"] for w, good in zip(windows, agreeing(slots), strict=True) if good])
        same.append(all(a == b for w in slots for a, b in w))
    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places, pa.list_(pa.int64())), pa.array(same, pa.bool_())], [*batch.schema.names[:-1], "places", "same"])


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> a row for each document and item that leaks into it:
    doc_id, item_id, n_matched, n_windows, verbatim (no slot has another value).

    Texts are taken whole.  Null and empty texts match nothing.  Rows that share a doc_id
    are one document, but slots agree within a text; a null doc_id or item_id is kept as
    such; repeated items count once.  Other columns are ignored, whatever their names;
    empty tables give an empty one.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = scratch.save(item_windows(benchmark, size), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # size of them at most

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(np.uint64)

    known = docs.sparkSession.sparkContext.broadcast(frequency_filters(items.select("window"), keys, (0,), FILTER_BITS)[0])
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                starts, ends, kinds, hashes, first = template(piece)
                owner = np.repeat(np.arange(len(piece)), np.diff(first))
                texts = span_hashes(prefix_hashes(piece.data), piece.offsets[:-1], piece.offsets[1:]).view(np.int64)
                found: list[tuple] = []
                for width in widths:
                    grams = ngram_hashes(hashes, width)
                    at = np.flatnonzero(holds(known.value, grams, FILTER_BITS))
                    at = at[owner[at] == owner[at + width - 1]]
                    found += [(int(g), int(owner[p]), int(p - first[owner[p]]), width, _slots(piece, starts, ends, kinds, p, p + width), _spelled(piece, starts, ends, kinds, p, p + width)) for p, g in zip(at.tolist(), grams[at].view(np.int64).tolist(), strict=True)]
                rows = pa.array([piece.rows.start + x[1] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), batch.column(0).take(rows), pa.array([int(texts[x[1]]) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.list_(pa.string())), pa.array([x[5] for x in found], pa.string()), pa.array([int(first[x[1] + 1] - first[x[1]]) for x in found], pa.int64())],
                    ["window", "doc_id", "text_hash", "doc_pos", "width", "doc_slots", "doc_template", "doc_tokens"],
                )

    seen = docs.select("doc_id", "text").mapInArrow(run, f"window long, doc_id {doc_type}, text_hash long, doc_pos long, width int, doc_slots array<string>, doc_template string, doc_tokens long")
    pairs = join_small(seen, items, ["window", "width"], "inner").where("item_template = doc_template AND (NOT exact OR item_slots = doc_slots) AND (NOT alone OR doc_tokens = width)")
    pairs = pairs.select("doc_id", "item_id", "n_windows", "text_hash", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"), "item_pos", F.arrays_zip(F.col("item_slots").alias("a"), F.col("doc_slots").alias("b")).alias("slots"))
    lines = pairs.groupBy("doc_id", "item_id", "n_windows", "text_hash", "diagonal").agg(F.collect_set(F.struct("item_pos", "slots")).alias("windows"))  # an item's own at most
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    lines = arrow_map(lines.select("doc_id", "item_id", "n_windows", "windows"), _judge, f"doc_id {doc_type}, item_id {item_type}, n_windows long, places array<long>, same boolean")
    found = lines.where(F.size("places") > 0).groupBy("doc_id", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"), F.bool_and("same").alias("verbatim"))
    return found.where(F.col("n_matched") >= coverage * F.col("n_windows")).select("doc_id", "item_id", "n_matched", "n_windows", "verbatim")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, into which no item leaks.

    A row goes by its own text (known by a 64-bit hash), so rows that share a doc_id, or have
    none, are judged apart, and equal texts alike.  Null and empty texts stay.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = scratch.save(leaks(by_text, benchmark).select(F.col("doc_id").alias("leaking text")).distinct(), "bad")
    small = bad.count() <= 50_000
    return docs.join(F.broadcast(bad) if small else bad, F.xxhash64(docs["text"]) == bad["leaking text"], "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, verbatim of every leak."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
