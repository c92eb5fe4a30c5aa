"""Operator 11, phrase collocation mining: pivot partitioning, as in MG-FSM.

Every occurrence of a phrase belongs to the leftmost occurrence of its rarest word, the pivot.
A document is rewritten into one fragment for each word: the word with those neighbours, at
most three on either side, that are no rarer than it and in the same piece.  Fragments are
routed to their word, equal ones as one with a count; what is mined there are the phrases
that hold the pivot, so each phrase is counted in one place and no other phrase is made.

"Rarer" may be any fixed order, so a table of fixed size says it: frequencies in quarter
octaves, by hash of the word (of words that share an entry the highest; ties go by hash).
What can't be frequent ends a fragment: a word that the exact counts don't keep, or a pair or
three words of which a bitmap says that they are rare (so a fragment may be cut in two at
its pivot; short ones repeat, and count as one row a task).  Both tables only prune; they
never lose a phrase, also where a large corpus fills them.  Pivots are dealt over buckets; a task sends each
bucket its fragments in one row.  A pivot with many occurrences is dealt over several
buckets by a hash of its fragments, and its phrases' counts are summed after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, Slice, byte_class, mix, ngram_hashes, runs, slices, span_texts, word_hashes
from ledgertide.llm.filters import frequency_filters, holds
from ledgertide.llm.shared import Scratch, group_starts, table

#: Words end at white space and at what ends a piece.
WORD = byte_class((0x20, 0x20), (0x09, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"), inverse=True)
BREAK = byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
MOST_WORDS = 4
MIN_COUNT = 30
TOP = 2_000
COVERED_PERCENT = 80
SCORE = 2_000_000
RANK_BITS = 22
#: A pivot gets a bucket for about so many of its occurrences.
PIVOT_ROWS = 1 << 17
#: A task sums its fragments, or its words, whenever it holds so many.
HELD = 600_000
SIDE = MOST_WORDS - 1
WINDOW = 2 * SIDE + 1
_U = np.uint64
_SEEDS = {2: _U(0x9FB21C651E98DF25), 3: _U(0xC13FA9A902A6328F)}


def language_seed(lang: str) -> np.uint64:
    raw = np.frombuffer(b"\0" + lang.encode(), np.uint8)
    return word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


class Words:
    """The words of a slice: spans, hashes (of the word and its language) and, for each, whether the
    next word continues its piece."""

    def __init__(self, piece: Slice, seeds: np.ndarray):
        self.data = FOLD[piece.data]
        self.starts, self.ends, first = runs(piece, WORD)
        self.doc = np.repeat(np.arange(len(piece)), np.diff(first))
        self.keys = mix(word_hashes(self.data, self.starts, self.ends) ^ seeds[self.doc])
        breaks = np.concatenate([[0], np.cumsum(BREAK[self.data])])
        self.joined = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.joined[:-1] = (self.doc[1:] == self.doc[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A key of each word with the n - 1 next ones, and whether these are joined."""
        keys = mix(ngram_hashes(self.keys, n) ^ _SEEDS[n])
        joined = np.ones(len(keys), bool)
        for k in range(n - 1):
            joined &= self.joined[k : k + len(keys)]
        return keys, joined


def each_slice(batch: pa.RecordBatch, seeds: dict[str, np.uint64]) -> Iterator[tuple[list[str], Words]]:
    """(text, lang) -> the languages of a slice's texts, and its words."""
    langs = batch.column(1).to_pylist()
    for lang in set(langs) - seeds.keys():
        seeds[lang] = language_seed(lang)
    for piece in slices(batch.column(0)):
        own = langs[piece.rows]
        yield own, Words(piece, np.array([seeds[x] for x in own], _U))


def frequent_keys(docs: DataFrame, min_count: int) -> np.ndarray:
    """A bitmap of the words, and of the joined pairs and threes, that may occur min_count times."""
    seeds: dict[str, np.uint64] = {}

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, words in each_slice(batch, seeds):
            yield words.keys
            for n in _SEEDS:
                keys, joined = words.grams(n)
                yield keys[joined]

    return frequency_filters(docs, keys_of, (min_count - 1,))[0]


def word_counts(docs: DataFrame, may: object) -> DataFrame:
    """lang, key, word, n of the words that may be frequent; with a null word, a language's
    number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, np.uint64] = {}
        totals: dict[str, int] = {}
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "key", "word"]).aggregate([("n", "sum")]).select(["lang", "key", "word", "n_sum"]).rename_columns(["lang", "key", "word", "n"])

        for batch in batches:
            for langs, words in each_slice(batch, seeds):
                per_doc = np.bincount(words.doc, minlength=len(langs))
                for lang, n in zip(langs, per_doc.tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                at = np.flatnonzero(holds(may.value, words.keys))
                at = at[np.argsort(words.keys[at], kind="stable")]
                cuts = group_starts([words.keys[at]])
                one = at[cuts]
                own = pa.array(langs, pa.string()).take(pa.array(words.doc[one]))
                held.append(pa.table({"lang": own, "key": words.keys[one].view(np.int64), "word": span_texts(words.data, words.starts[one], words.ends[one]), "n": np.diff(np.append(cuts, len(at)))}))
                rows += len(one)
                if rows >= HELD:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from held[0].to_batches(max_chunksize=100_000)
                        held, rows = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=100_000)
        if totals:
            none = pa.nulls(len(totals))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), none.cast(pa.int64()), none.cast(pa.string()), pa.array(list(totals.values()), pa.int64())], ["lang", "key", "word", "n"])

    return docs.mapInArrow(run, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def rank_table(words: DataFrame, bits: int) -> np.ndarray:
    """The frequency of each entry's most frequent word in quarter octaves from 1; 0: no word.
    The driver gets at most 2**bits rows of two numbers."""
    entry = F.shiftrightunsigned("key", 64 - bits).cast("int")
    rows = words.groupBy(entry.alias("entry")).agg(F.max((F.floor(F.log2("n") * 4) + 1).cast("tinyint")).alias("level")).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[rows["entry"].to_numpy()] = rows["level"].to_numpy()
    return out


def fragments(docs: DataFrame, may: object, ranks: object, bits: int, pivot_rows: int) -> DataFrame:
    """bucket and, in lists of equal length, lang, salted, left (words before the pivot), words (keys of 8 bytes
    each) and n of its fragments: a row for each task and bucket, or a few."""
    # a bucket gets about as much as a quarter of one input partition gives
    split = max(8, min(20, (4 * docs.rdd.getNumPartitions() - 1).bit_length()))

    def windows(words: Words) -> tuple[np.ndarray, ...]:
        """Pivots with their words on the left and right, and the pivots' levels."""
        level = ranks.value[(words.keys >> _U(64 - bits)).astype(np.int64)].astype(np.int16)
        n = len(level)
        joined, threes = np.zeros(n, bool), np.zeros(n, bool)
        for size, out in ((2, joined), (3, threes)):
            keys, whole = words.grams(size)
            out[: len(keys)] = whole & (holds(may.value, keys) > 0)
        joined &= level > 0
        joined[:-1] &= level[1:] > 0
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for side, reach in ((-1, left), (1, right)):
            open_ = np.arange(n)
            for step in range(1, SIDE + 1):
                at = open_ + side * step
                inside = (at >= 0) & (at < n)
                open_, at = open_[inside], at[inside]
                link = joined[at] if side < 0 else joined[at - 1]
                if step > 1:
                    link = link & (threes[at] if side < 0 else threes[at - 2])
                more = (level[at] > level[open_]) | ((level[at] == level[open_]) & (words.keys[at] > words.keys[open_]))
                if side > 0:
                    more |= words.keys[at] == words.keys[open_]
                open_ = open_[link & more]
                reach[open_] = step
        center = np.concatenate([[False], threes[:-1]])
        apart = (left > 0) & (right > 0) & ~center
        one, two = np.flatnonzero((left + right > 0) & ~apart), np.flatnonzero(apart)
        none = np.zeros(len(two), np.int64)
        pivots = np.concatenate([one, two, two])
        return pivots, np.concatenate([left[one], left[two], none]), np.concatenate([right[one], none, right[two]]), level[pivots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, np.uint64] = {}
        held: list[pa.Table] = []
        rows = 0
        keys = ["bucket", "lang", "salted", "left", "words"]

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"])

        def packed(whole: pa.Table) -> pa.RecordBatch:
            whole = whole.sort_by("bucket").combine_chunks()
            buckets = whole["bucket"].to_numpy()
            cuts = group_starts([buckets])
            ends = pa.array(np.append(cuts, len(buckets)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, whole[c].combine_chunks()) for c in ("lang", "salted", "left", "words", "n_sum")]
            return pa.RecordBatch.from_arrays([pa.array(buckets[cuts]), *lists], ["bucket", "lang", "salted", "left", "words", "n"])

        for batch in batches:
            for langs, words in each_slice(batch, seeds):
                if not len(words.keys):
                    continue
                pivots, left, right, level = windows(words)
                if not len(pivots):
                    continue
                size = left + right + 1
                lo = np.zeros(len(pivots) + 1, np.int64)
                np.cumsum(size, out=lo[1:])
                at = np.arange(lo[-1]) + np.repeat(pivots - left - lo[:-1], size)
                own = words.keys[at]
                body = pa.Array.from_buffers(pa.large_binary(), len(pivots), [None, pa.py_buffer(lo * 8), pa.py_buffer(own.view(np.uint8))]).cast(pa.binary())
                # equal fragments meet under one salt
                place = np.arange(len(own), dtype=_U) - np.repeat(lo[:-1].astype(_U), size)
                whole = mix(np.add.reduceat(own * mix(place + _U(1)), lo[:-1]))
                parts = np.maximum(1, np.exp2(level / 4).astype(np.int64) // pivot_rows).astype(_U)
                bucket = mix(words.keys[pivots] + whole % parts * _U(0x9E3779B97F4A7C15)) >> _U(64 - split)
                lang = pa.array(langs, pa.string()).take(pa.array(words.doc[pivots]))
                held.append(pa.table({"bucket": bucket.astype(np.int32), "lang": lang, "salted": parts > 1, "left": left.astype(np.int8), "words": body, "n": np.ones(len(pivots), np.int64)}))
                rows += len(pivots)
                if rows >= HELD:
                    held = [summed().rename_columns([*keys, "n"])]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield packed(held[0].rename_columns([*keys, "n_sum"]))
                        held, rows = [], 0
        if held:
            yield packed(summed())

    return docs.mapInArrow(run, "bucket int, lang array<string>, salted array<boolean>, left array<tinyint>, words array<binary>, n array<long>")


def mined(parts: DataFrame, min_count: int) -> DataFrame:
    """lang, gram (big-endian keys of 8 bytes), n: the phrases that hold their fragment's pivot; of pivots
    with one bucket only what is frequent, of others what one bucket holds."""

    def mine(group: pa.Table) -> pa.Table:
        column = lambda c: group[c].combine_chunks().flatten()
        lang, salted, n = column("lang"), column("salted"), column("n").to_numpy()
        left = column("left").to_numpy().astype(np.int64)
        raw = column("words").cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        keys = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(_U).byteswap()
        lo = (ends - ends[0]) // 8
        size = np.diff(lo)
        out = []
        for length in range(2, MOST_WORDS + 1):
            found = [(has, lo[has] + left[has] - before) for before in range(length) for has in [np.flatnonzero((left >= before) & (size - left >= length - before))]]
            owner, begin = (np.concatenate(x) for x in zip(*found, strict=True))
            grams = keys[begin[:, None] + np.arange(length)]
            body = pa.Array.from_buffers(pa.binary(8 * length), len(owner), [None, pa.py_buffer(grams.view(np.uint8).reshape(-1))]).cast(pa.binary())
            at = pa.array(owner)
            counts = pa.table({"lang": lang.take(at), "gram": body, "salted": salted.take(at), "n": n[owner]}).group_by(["lang", "gram", "salted"]).aggregate([("n", "sum")])
            counts = counts.filter(pc.or_(counts["salted"], pc.greater_equal(counts["n_sum"], min_count)))
            out.append(counts.select(["lang", "gram", "n_sum"]).rename_columns(["lang", "gram", "n"]))
        return pa.concat_tables(out)

    return parts.groupBy("bucket").applyInArrow(mine, "lang string, gram binary, n long")


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int, rank_bits: int, pivot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text, lang) -> totals (lang, n_words), words (lang, gram, word, n) and phrases of two words or
    more (lang, gram, n), both with min_count occurrences or more."""
    share = docs.sparkSession.sparkContext.broadcast
    may = share(frequent_keys(docs, min_count))
    counts = scratch.save(word_counts(docs, may).where((F.col("n") >= min_count) | F.col("word").isNull()), "words")
    words = counts.where("word IS NOT NULL")
    ranks = share(rank_table(words, rank_bits))
    grams = mined(fragments(docs, may, ranks, rank_bits, pivot_rows), min_count).groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    totals = counts.where("word IS NULL").select("lang", F.col("n").alias("n_words"))
    return totals, words.select("lang", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("gram"), "word", "n"), scratch.save(grams, "grams")


def first_ranks(rows: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """The first ``top`` of each language, with rank.  A language's rows are cut in ``parts`` first, so
    that no task sorts more than so many times top of them."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cut = rows.withColumn("cut", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", place("lang", "cut")).where(F.col("rank") <= top)
    return cut.withColumn("rank", place("lang")).where(F.col("rank") <= top).drop("cut")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, rank_bits: int = RANK_BITS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(text, lang) -> lang, rank, phrase, a, l, r, n, score: the phrases whose parts stand together most.

    A-Z are lower-cased; pieces end at .,;:!? and line breaks, words at blanks and tabs.  Of each
    language (null: ``und``): candidates are phrases of 2 to 4 words with min_count places or
    more; a is that count, l and r those of the two parts of the cut with the lowest
    floor(2000000 * a / (l + r)), of equal ones the first; n counts all words.  A candidate that
    lies in a longer one with 80 per cent of its count or more goes.  Each row is a document;
    repeated rows count as often as they stand.  Null and empty texts have no words.  Other
    columns are ignored; an empty table gives one.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    totals, words, grams = frequent_phrases(docs, scratch, min_count, rank_bits, pivot_rows)
    size = F.length("gram") / 8
    counts = words.drop("word").unionByName(grams)
    part = lambda begin, n: F.expr(f"substring(gram, 8 * ({begin}) + 1, 8 * ({n}))")
    cuts = grams.select("lang", "gram", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), (size - 1).cast("int"))).alias("k"))
    cuts = cuts.select("lang", "gram", "a", "k", part("0", "k").alias("head"), part("k", "4").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("gram").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("gram").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCORE} DIV CAST(l + r AS DECIMAL(20,0))")
    best = cuts.groupBy("lang", "gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")

    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), (size - 1).cast("int")), lambda m: F.transform(F.sequence(F.lit(0), size.cast("int") - m), lambda i: F.struct(i.alias("i"), m.alias("m")))))).alias("at")
    longer = grams.where(size > 2).select("lang", "gram", "n", inside).select("lang", part("at.i", "at.m").alias("gram"), "n").groupBy("lang", "gram").agg(F.max("n").alias("most"))
    kept = best.join(longer, ["lang", "gram"], "left").where(F.col("most").isNull() | (100 * F.col("most") < COVERED_PERCENT * F.col("a"))).drop("most")
    spelled = kept.select("*", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("i")).withColumn("one", part("i", "1"))
    spelled = spelled.join(words.select("lang", F.col("gram").alias("one"), "word"), ["lang", "one"]).groupBy("lang", "gram", "a", "l", "r", "score")
    phrases = spelled.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first_ranks(phrases.drop("gram"), top).join(totals, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score over all documents."""
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
places AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS m)),
total AS (SELECT lang, count(*) AS n FROM places WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS n FROM places GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE m > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, k, l.n AS l, r.n AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.n + r.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
