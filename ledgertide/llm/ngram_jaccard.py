"""Operator 2, n-gram Jaccard join: size-banded tiles, hashed bitmap signatures whose bit
counts bound the overlap from above, then exact intersection of sorted arrays.

1. A pass over all texts counts the documents of every shingle (sorted, packed keys per
   task, summed per key range) into one bitmap of fixed size: the shingles that more than
   ``HOT`` documents hold.  A key range that would fill its part of the bitmap takes a
   higher bound, so that the bitmap says as much at any size of the corpus.
2. A second pass gives each document's digest, tile keys and bitmap signature; texts with
   equal sets become one class.  In the order (not hot, hot; then by hash) a class's first
   n - ceil(0.8 n) + 1 shingles must hold one of any linked class's: these are its tile
   keys.  The order may be any, so a crowded bitmap costs time, never a link.
3. Tiles of other keys are small: their pairs whose sizes fit, and whose places of the key
   leave enough behind it, pass the bit-count bound or go.  The survivors' arrays are made
   in a third pass over the texts, for these classes alone, and intersected.
4. Tiles of hot keys are cut by size band and then into blocks of bounded volume; every
   pair of blocks is one unit of work that carries the arrays, and checks a pair of
   classes only where the key is the first that both have.  It returns counts and a
   spanning forest, not all pairs.
5. Components by large-star/small-star.

Words are hashed by tabulation (``bytekit.word_hashes``), so that no structure of a text
makes two of them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, NOT_SPACE, Slice, mix, ngram_hashes, runs, slices, word_hashes
from ledgertide.llm.components import connected_components
from ledgertide.llm.filters import FILTER_BITS, frequency_filters, holds
from ledgertide.llm.shared import Scratch, group_starts, grouped, table

SHINGLE = 5
PERCENT = 80
HOT = 64
BLOCK_SHINGLES = 300_000
#: The hot keys fill at most this share of their bitmap.
FILL = 1 / 16
_U = np.uint64


def shingle_arrays(piece: Slice, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as a sorted array of 64-bit hashes."""
    starts, ends, first = runs(piece, NOT_SPACE)
    words = word_hashes(FOLD[piece.data], starts, ends)
    grams = ngram_hashes(words, size)
    for i in range(len(piece)):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield ngram_hashes(words[a:b], int(b - a))
        else:
            yield np.zeros(0, _U)


def band_edges(percent: int = PERCENT, top: int = 1 << 40) -> np.ndarray:
    """Sizes at which bands begin: sizes within the ratio lie in the same or adjacent bands."""
    edges = [1, 2]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array(edges, np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the hashes' low bits, about one bit a shingle."""
    width = 1 << min(14, max(6, (len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount((hashes & _U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """The bitmaps (of width bytes or more) as rows of width bytes."""
    out = np.zeros((len(bits), width // 8), _U)
    for length in {len(b) for b in bits}:
        at = [i for i, b in enumerate(bits) if len(b) == length]
        rows = np.frombuffer(b"".join(bits[i] for i in at), _U).reshape(len(at), -1)
        while rows.shape[1] > width // 8:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def enough(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def bounded(differing: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the sets may be alike if so many of their bitmaps' bits differ: each bit that
    differs needs a shingle of its own that only one set has."""
    return enough((a + b - differing) // 2, a, b, percent)


def cold_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the same key whose sizes fit and that can be alike if this is their first common
    key: what comes before it in the two orders then has nothing in common."""
    for part in grouped(batches, ["key"]):
        key, n, node, place = (part[c].to_numpy() for c in ("key", "n", "node", "place"))
        rest = n - place  # the shingles from the key on
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lag in range(1, len(key)):
            a = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(a):
                break
            b = a + lag
            ok = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & enough(np.minimum(rest[a], rest[b]), n[a], n[b], percent)
            found.append((node[a[ok]], node[b[ok]]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def likely(batch: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose bit counts leave enough overlap: a, b, na, nb, bits_a, bits_b -> a, b."""
    na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
    bits = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b")]
    width = np.array([[len(b) for b in side] for side in bits]).reshape(2, -1).min(0)
    ok = np.zeros(batch.num_rows, bool)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x, y = (folded([side[i] for i in at], int(w)) for side in bits)
        ok[at] = bounded(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), na[at], nb[at], percent)
    yield batch.select(["a", "b"]).filter(pa.array(ok))


def verify(batch: pa.RecordBatch, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose arrays are alike: a, b, copies_a, copies_b, sa, sb -> the first four."""
    keep = []
    sa, sb = batch.column("sa"), batch.column("sb")
    for i in range(batch.num_rows):
        x, y = np.frombuffer(sa[i].as_buffer(), _U), np.frombuffer(sb[i].as_buffer(), _U)
        common = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(bool(enough(common, len(x), len(y), percent)))
    yield batch.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(keep, pa.bool_()))


def block_links(part: pa.Table, percent: int) -> tuple[list, list]:
    """All links of one pair of blocks of a hot tile: (node, links) and a spanning forest."""
    key = _U(part["key"][0].as_py() & 0xFFFFFFFFFFFFFFFF)
    n, node, copies, home, block = (part[c].to_numpy() for c in ("n", "node", "copies", "home", "block"))
    same = part["bi"][0].as_py() == part["bj"][0].as_py()
    width = min(len(b.as_py()) for b in part["bits"])
    bits = folded(part["bits"].to_pylist(), width)
    sets = [np.frombuffer(x, _U) for x in part["shingles"].to_pylist()]
    # the tile keys before this one, of which a pair must have none in common
    earlier = []
    for x in part["keys"].to_pylist():
        own = np.frombuffer(x, _U)
        earlier.append(np.sort(own[: int(np.flatnonzero(own == key)[0])]))
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    before, many = np.concatenate(earlier), np.array([len(e) for e in earlier])
    before_at = np.concatenate([[0], np.cumsum(many)])

    def hits(probe: np.ndarray, pool: np.ndarray, pool_at: np.ndarray, lengths: np.ndarray, who: np.ndarray) -> np.ndarray:
        """How many of probe (sorted) each of who has in its stretch of pool."""
        out = np.zeros(len(who), np.int64)
        if not len(probe) or not len(who):
            return out
        spread = lengths[who]
        owner = np.repeat(np.arange(len(who)), spread)
        if not len(owner):
            return out
        stops = np.cumsum(spread)
        values = pool[np.repeat(pool_at[who] - (stops - spread), spread) + np.arange(stops[-1])]
        spot = np.searchsorted(probe, values)
        spot[spot == len(probe)] = 0
        return np.bincount(owner[probe[spot] == values], minlength=len(who))

    links = np.zeros(len(n), np.int64)
    root = np.arange(len(n))
    forest = []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = j[(home[j] | home[i]) & ((block[j] != block[i]) | same) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        j = j[bounded(np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64), n[i], n[j], percent)]
        j = j[hits(earlier[i], before, before_at, many, j) == 0]
        j = j[enough(hits(sets[i], flat, at, size, j), n[i], n[j], percent)]
        links[i] += copies[j].sum()
        links[j] += copies[i]
        for k in j:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                forest.append((int(node[i]), int(node[k])))
    return [(int(v), int(c)) for v, c in zip(node[links > 0], links[links > 0], strict=True)], forest


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, hot: int = HOT, filter_bits: int = FILTER_BITS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, n_links, a row for each row.

    Words: A-Z lower-cased, cut at ASCII white space; shingles of ``size`` words, or the
    whole text where it has fewer.  Two rows link when their sets' Jaccard similarity is
    ``percent`` / 100 or more; n_links counts the other rows that a row links with (copies
    included), component_id is the smallest doc_id that links reach.  Null, empty and
    blank texts have no shingle and link with nothing: their own doc_id is their
    component.  Rows are judged one by one, also where doc_ids repeat; a null doc_id is
    never the smallest unless a component has no other.  Shingles are compared as 64-bit
    hashes, whole sets as 128-bit digests.  Other columns are ignored, whatever their names; an
    empty table gives one.
    """
    return judged_rows(docs, size, percent, hot, filter_bits, block_shingles).select("doc_id", "n_shingles", "component_id", "n_links")


def judged_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, hot: int = HOT, filter_bits: int = FILTER_BITS, block_shingles: int = BLOCK_SHINGLES, scratch: Scratch | None = None) -> DataFrame:
    """The columns of ``jaccard_components``, text_hash (xxhash64 of text), and component: the same
    number in all rows that links join, whatever their doc_ids; null without a shingle.
    Of the tables in scratch only two narrow ones are left, which the result reads."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")

    def all_shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for piece in slices(batch.column(0)):
            yield from shingle_arrays(piece, size)

    crowded = spark.sparkContext.broadcast(frequency_filters(docs.select("text"), all_shingles, (hot,), filter_bits, FILL)[0])
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def is_hot(hashes: np.ndarray) -> np.ndarray:
        return holds(crowded.value, hashes, filter_bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                n, s1, s2, keys, bits = [], [], [], [], []
                for own in shingle_arrays(piece, size):
                    n.append(len(own))
                    one, two = digest(own) if len(own) else (None, None)
                    s1.append(one)
                    s2.append(two)
                    first = np.argsort(is_hot(own), kind="stable")[: len(own) + (-percent * len(own)) // 100 + 1]
                    keys.append(own[first].tobytes() if len(own) else None)
                    bits.append(bitmap(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.rows.start, len(piece)), batch.column(2).slice(piece.rows.start, len(piece)), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, bits))],
                    ["doc_id", "text_hash", "n", "s1", "s2", "keys", "bits"],
                )

    sketches = scratch.save(docs.mapInArrow(sketch, f"doc_id {doc_type}, text_hash long, n long, s1 long, s2 long, keys binary, bits binary"), "sketches")
    classes = sketches.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "keys", "bits")))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = scratch.save(sketches.select("doc_id", "text_hash", "n", "s1", "s2"), "rows")
    scratch.drop("sketches")

    edges_of_bands = band_edges(percent)

    def keyed(hot_ones: bool) -> DataFrame:
        """A row a tile key that is hot, or isn't: key, band, node, n, place (in the order)."""

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = [np.frombuffer(x.as_buffer(), _U) for x in batch.column("keys")]
                sizes = np.array([len(k) for k in keys])
                flat = np.concatenate(keys)
                at = np.flatnonzero(is_hot(flat) == hot_ones)
                owner = np.repeat(np.arange(len(keys)), sizes)[at]
                place = at - (np.cumsum(sizes) - sizes)[owner]
                n = batch.column("n").to_numpy()[owner]
                band = np.searchsorted(edges_of_bands, n, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), pa.array(band), batch.column("node").take(pa.array(owner)), pa.array(n), pa.array(place.astype(np.int32))], ["key", "band", "node", "n", "place"])

        return classes.select("node", "n", "keys").mapInArrow(explode, "key long, band int, node long, n long, place int")

    cold = keyed(False).select("key", "n", "node", "place").repartition("key").sortWithinPartitions("key", "n")
    pairs = scratch.save(cold.mapInArrow(lambda it: cold_pairs(it, percent), "a long, b long").distinct(), "pairs")
    signed = classes.select("node", "n", "bits")
    pairs = pairs.join(signed.toDF("a", "na", "bits_a"), "a").join(signed.toDF("b", "nb", "bits_b"), "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    candidates = scratch.save(pairs.mapInArrow(lambda it: (out for b in it for out in likely(b, percent)), "a long, b long"), "candidates")
    scratch.drop("pairs")

    tiles = scratch.save(keyed(True).select("key", "band", "node", "n"), "hot")
    tiles = tiles.select("key", "node", "n", F.explode(F.array("band", F.col("band") - 1)).alias("tile"), "band")
    tiles = tiles.withColumn("home", F.col("band") == F.col("tile"))
    volume = tiles.groupBy("key", "tile").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"), F.max("home").alias("any"), F.count(F.lit(1)).alias("members"))
    volume = scratch.save(volume.where("any AND members > 1").select("key", "tile", "blocks"), "volume")
    tiles = scratch.save(tiles.join(volume, ["key", "tile"]).select("key", "tile", "blocks", "home", "node", "n"), "tiles")
    scratch.drop("hot", "volume")

    wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).union(tiles.select("node")).distinct()
    wanted = scratch.save(classes.join(wanted, "node", "left_semi").select("s1", "s2", "node", "copies"), "wanted")
    arrays = scratch.save(_arrays(docs.select("text"), wanted, size, filter_bits), "arrays")

    found = candidates.join(arrays.toDF("a", "copies_a", "sa"), "a").join(arrays.toDF("b", "copies_b", "sb"), "b")
    links = found.mapInArrow(lambda it: (out for b in it for out in verify(b, percent)), "a long, b long, copies_a long, copies_b long")
    links = scratch.save(links, "links")
    scratch.drop("candidates", "wanted")

    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("key", "tile", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "home", "node", "n")
    tiles = tiles.join(classes.select("node", "bits", "keys"), "node").join(arrays, "node")
    unit = ["key", "tile", "bi", "bj"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, unit, 500):
            starts = group_starts([part[c].to_numpy() for c in unit])
            for a, b in zip(starts, [*starts[1:], part.num_rows], strict=True):
                if b - a < 2:
                    continue
                counts, forest = block_links(part.slice(a, b - a), percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in counts] + [x[0] for x in forest], pa.int64()), pa.array([None] * len(counts) + [x[1] for x in forest], pa.int64()), pa.array([x[1] for x in counts] + [None] * len(forest), pa.int64())],
                    ["a", "b", "links"],
                )

    dense = scratch.save(tiles.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(work, "a long, b long, links long"), "dense")
    scratch.drop("tiles", "arrays")

    edges = links.select("a", "b").union(dense.where("b IS NOT NULL").select("a", "b"))
    roots = connected_components(edges, scratch)
    counts = links.select(F.col("a").alias("node"), F.col("copies_b").alias("links")).union(links.select("b", "copies_a")).union(dense.where("b IS NULL").select("a", "links"))
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    named = scratch.save(roots.join(classes.select("node", "least"), "node"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", "root", "component_id")
    result = classes.select("s1", "s2", "node", "least", "copies").join(named, "node", "left").join(counts, "node", "left")
    result = result.select("s1", "s2", F.coalesce("root", "node").alias("component"), F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = scratch.save(result, "result")
    scratch.drop("classes", "links", "dense", "named")
    joined = rows.join(result, ["s1", "s2"], "left")
    return joined.select("doc_id", "text_hash", "component", F.col("n").alias("n_shingles"), F.when(F.col("s1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    one, two = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
    return one, two


def _arrays(texts: DataFrame, wanted: DataFrame, size: int, filter_bits: int) -> DataFrame:
    """wanted (s1, s2, node, copies) -> node, copies, shingles: the sorted arrays of these classes,
    made again from the texts.  A task gives a class once, whatever its copies."""

    def first_digests(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(batch.column(0).to_numpy().view(_U))

    known = texts.sparkSession.sparkContext.broadcast(frequency_filters(wanted.select("s1"), first_digests, (0,), filter_bits)[0])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            for piece in slices(batch.column(0)):
                out: list[tuple[int, int, bytes]] = []
                for own in shingle_arrays(piece, size):
                    key = digest(own)
                    if not len(own) or key in given or not holds(known.value, mix(np.array(key[:1]).view(_U)), filter_bits)[0]:
                        continue
                    given.add(key)
                    out.append((*key, own.tobytes()))
                if len(given) > 1_000_000:
                    given.clear()
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["s1", "s2", "shingles"])

    made = texts.mapInArrow(make, "s1 long, s2 long, shingles binary").groupBy("s1", "s2").agg(F.first("shingles").alias("shingles"))
    return made.join(wanted, ["s1", "s2"]).select("node", "copies", "shingles")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * common >= 80 * (nx + ny - common)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_of.y, doc_id)) AS component_id,
       coalesce(counts.n, 0) AS n_links
FROM sets LEFT JOIN least_of ON doc_id = least_of.x LEFT JOIN counts ON doc_id = counts.x
"""


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without the near duplicates: of each component
    one row stays, one with the smallest doc_id (a null only where there is no other).

    A row goes by its own doc_id and text, so that rows that share a doc_id, or have none,
    are kept where no link joins them.  Rows without a link always stay.
    """
    scratch, work = Scratch(docs.sparkSession, "kept"), Scratch(docs.sparkSession, "jaccard")
    linked = judged_rows(docs, scratch=work).where("n_links > 0").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    linked = scratch.save(linked, "linked")
    work.end()
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")).select("first.doc_id", "first.text_hash")
    first = scratch.save(first, "first")

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = right.select(F.col("doc_id").alias("own id"), F.col("text_hash").alias("own text"))
        return left.join(other, left["doc_id"].eqNullSafe(other["own id"]) & (F.xxhash64(left["text"]) == other["own text"]), how)

    same = linked["doc_id"].eqNullSafe(first["doc_id"]) & (linked["text_hash"] == first["text_hash"])
    gone = scratch.save(linked.join(first, same, "left_anti"), "gone")
    kept = meet(docs, gone, "left_anti")
    twice = scratch.save(linked.where("rows > 1").join(first, same, "left_semi"), "twice")
    if twice.isEmpty():
        return kept
    return meet(kept, twice, "left_anti").unionByName(meet(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
