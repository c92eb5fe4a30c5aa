"""Operator 9, line dedup: explode normalised lines, hash, count distinct documents per
hash, drop lines over the threshold, reassemble by position.

Only 24 bytes a line are shuffled for the counts (a BLAKE2b digest of 128 bits, so that
equal digests are equal lines: 10**12 lines make no collision that one might expect, and
no structure of their bytes makes one); a line that a third of all documents hold is
pre-aggregated before the shuffle, and the join back to its holders is one that AQE
splits.  Texts are shuffled once, when a document meets the lines that it loses.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, NOT_SPACE, Slice, runs, slices
from ledgertide.llm.shared import Scratch, arrow_map, table

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def split_lines(piece: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the index of each text's first line."""
    breaks = np.flatnonzero(piece.data == 10)
    per_text = np.diff(np.searchsorted(breaks, piece.offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    starts[opens], starts[~opens] = piece.offsets[:-1], breaks + 1
    closes = np.zeros(first[-1], bool)
    closes[first[1:] - 1] = True
    ends[closes], ends[~closes] = piece.offsets[1:], breaks
    return starts, ends, first


def line_keys(piece: Slice, min_chars: int) -> tuple[np.ndarray, ...]:
    """Lines as split_lines has them, which of them are long enough, and the two halves of the
    digest of each line's key (0 where it's too short)."""
    starts, ends, first = split_lines(piece)
    word_starts, word_ends, _ = runs(piece, NOT_SPACE)
    a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    some = b > a
    lo = np.where(some, np.append(word_starts, 0)[a], starts)
    hi = np.where(some, np.append(word_ends, 0)[b - 1], starts)
    points = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
    keep = points[hi] - points[lo] >= min_chars
    low = memoryview(FOLD[piece.data])
    halves = np.zeros((len(starts), 2), np.int64)
    at = np.flatnonzero(keep)
    digests = b"".join([blake2b(low[a:b], digest_size=16).digest() for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True)])
    halves[at] = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return starts, ends, first, keep, halves[:, 0], halves[:, 1]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text) -> doc_id, text (without the dropped lines), n_lines, n_dropped.

    A line's key is the line without ASCII white space at either end, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_documents`` documents or more hold
    lose all their lines, except in the largest doc_id that holds them.  Each row is a
    document: rows with the same doc_id count as several and lose the same lines.  A null
    doc_id is smaller than any other.  A null or empty text is one empty line, never
    dropped, and comes back empty.  Other columns are ignored; an empty table gives one.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "lines")

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch.column(1)):
            _, _, first, keep, one, two = line_keys(piece, min_chars)
            at = np.flatnonzero(keep)
            owner = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((two[at], one[at], owner))
            at, owner = at[order], owner[order]
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (one[at][1:] != one[at][:-1]) | (two[at][1:] != two[at][:-1])
            at, owner = at[new], owner[new]
            yield pa.RecordBatch.from_arrays([pa.array(one[at]), pa.array(two[at]), batch.column(0).slice(piece.rows.start).take(pa.array(owner))], ["h1", "h2", "doc_id"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    lines = arrow_map(docs, keys, f"h1 long, h2 long, doc_id {doc_type}")
    common = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_documents)
    common = scratch.save(common.select("h1", "h2", "keeper"), "common")
    losses = lines.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    losses = losses.groupBy(F.col("doc_id").alias("loser")).agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))

    def rebuild(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lost = batch.column(2)
        for piece in slices(batch.column(1)):
            starts, ends, first, keep, one, two = line_keys(piece, min_chars)
            texts, counts, dropped = [], [], []
            for i in range(len(piece)):
                a, b = first[i], first[i + 1]
                counts.append(int(b - a))
                gone = lost[piece.rows.start + i].as_py()
                if not gone:
                    texts.append(piece.bytes_of(i))
                    dropped.append(0)
                    continue
                gone = {(x["h1"], x["h2"]) for x in gone}
                stay = [j for j in range(a, b) if not (keep[j] and (int(one[j]), int(two[j])) in gone)]
                texts.append(b"\n".join(piece.data[starts[j] : ends[j]].tobytes() for j in stay))
                dropped.append(int(b - a - len(stay)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.rows.start, len(piece)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    joined = docs.join(losses, F.col("doc_id").eqNullSafe(F.col("loser")), "left").select("doc_id", "text", "lost")
    return arrow_map(joined, rebuild, f"doc_id {doc_type}, text string, n_lines long, n_dropped long")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone
  FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
