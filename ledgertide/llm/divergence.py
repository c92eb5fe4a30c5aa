"""Operator 12, source divergence audit: how far each source's use of terms is from that of
the other sources of its language, and which terms it overuses.

DuckDB shard aggregation: counts are dealt over shards by a hash of language and term.  In
each shard DuckDB counts the documents of each term, drops the rare ones, and, once the totals
are known, makes the shard's part of every pair's sum; Spark merges parts, totals and ranks.

A term that a group lacks has the count 0 and so a value that depends on the group alone.
A pair's sum over all terms is therefore made of the few that both have (one join in a
shard, summed there), of how often each count occurs in a group (a histogram), and of what is
left, a product.  No table of all terms by all groups is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, byte_class, runs, slices, span_texts, word_hashes
from ledgertide.llm.shared import Scratch, group_starts, grouped, table

TERM = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
MIN_DOCUMENTS = 10
TOP_TERMS = 10
#: A task sums its counts whenever it holds so many rows of them.
HELD_ROWS = 600_000
#: A shard is worked on in runs of whole terms of about so many rows.
RUN_ROWS = 200_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def database() -> duckdb.DuckDBPyConnection:
    """An engine in memory, of one thread; what it is given is bounded, so it never spills."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})


def ask(con: duckdb.DuckDBPyConnection, sql: str, **tables: pa.Table) -> pa.Table:
    for name, rows in tables.items():
        con.register(name, rows)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """(text, lang, source; null: '') -> lang, source, term, n (places), docs (documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = database()
        codes: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return ask(con, "SELECT g, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL", held=pa.concat_tables(held))

        def named(counts: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(codes)
            column = lambda k: pa.array([x[k] for x in names], pa.string()).take(counts["g"].combine_chunks())
            yield from pa.table([column(0), column(1), counts["term"].cast(pa.string()), counts["n"], counts["docs"]], schema=COUNTS).to_batches(max_chunksize=100_000)

        for batch in batches:
            of_row = np.array([codes.setdefault(x, len(codes)) for x in zip(*(batch.column(k).fill_null("").to_pylist() for k in (1, 2)), strict=True)], np.int32)
            for piece in slices(batch.column(0)):
                data = FOLD[piece.data]
                starts, ends, first = runs(piece, TERM)
                words = word_hashes(data, starts, ends)
                doc = np.repeat(np.arange(len(piece)), np.diff(first))
                group = of_row[piece.rows.start : piece.rows.stop][doc]
                order = np.lexsort((doc, group, words))
                words, group, doc = words[order], group[order], doc[order]
                cuts = group_starts([words, group])
                new_doc = np.zeros(len(words) + 1, np.int64)
                new_doc[1:][group_starts([words, group, doc])] = 1
                seen = np.cumsum(new_doc)
                ends_at = np.append(cuts[1:], len(words))
                at = order[cuts]
                held.append(pa.table({"g": group[cuts], "term": span_texts(data, starts[at], ends[at]), "n": ends_at - cuts, "docs": seen[ends_at] - seen[cuts]}))
                rows += len(cuts)
                if rows >= HELD_ROWS:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from named(held[0])
                        held, rows = [], 0
        if held:
            yield from named(summed())

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def by_shard(rows: DataFrame, sql: str, schema: str, shards: int) -> DataFrame:
    """The SQL over table ``shard`` for runs of whole (lang, term) of each of the hash shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = database()
        for part in grouped(batches, ["lang", "term"], RUN_ROWS):
            yield from ask(con, sql, shard=part).to_batches(max_chunksize=100_000)

    return rows.repartition(shards, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, schema)


_P = "CAST(1 + (CAST({0} + 2 AS HUGEINT) * 1000000000) // ({1} + 2 * v) AS BIGINT)"
_KEPT = """
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INT AS lead
FROM shard QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}"""
_PARTS = f"""
WITH p AS (
  SELECT lang, source, term, n, {_P.format('n', 'own_n')} AS p, {_P.format('0', 'own_n')} AS p0, {_P.format('sum(n) OVER (PARTITION BY lang, term)', 'lang_n')} AS q FROM shard),
terms AS (
  SELECT lang, source, term, ((p - q) * (p - q)) // (p + q) AS f FROM p WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {{top}})
SELECT 0 AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS c, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) - ((a.p - b.p0) * (a.p - b.p0)) // (a.p + b.p0)
    - ((a.p0 - b.p) * (a.p0 - b.p)) // (a.p0 + b.p) + ((a.p0 - b.p0) * (a.p0 - b.p0)) // (a.p0 + b.p0))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 1, lang, source, '', n, count(*) FROM p GROUP BY ALL
UNION ALL SELECT 2, lang, source, term, 0, f FROM terms"""


def _p(count: str, total: str) -> str:
    """A term's smoothed share, in billionths and exact."""
    return f"(1 + CAST(CAST({count} + 2 AS DECIMAL(20,0)) * CAST(1000000000 AS DECIMAL(10,0)) DIV CAST({total} + 2 * v AS DECIMAL(20,0)) AS BIGINT))"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) DIV ({p} + {q}))"


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(text, lang, source) -> lang, source, part, item, value, rank.

    Null text, lang and source count as ''.  Terms are runs of ASCII letters and non-ASCII
    characters, A-Z lower-cased; a language keeps those of ``min_documents`` of its documents
    or more.  Part ``pair``: each other source of the language, with the divergence over all
    kept terms (0 where none is kept).  Part ``term``: the group's terms that it uses more than
    its language does, the ``top`` by value.  Each row is a document; repeated rows count as
    often as they stand.  Other columns are ignored; an empty table gives one.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    docs = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = scratch.save(by_shard(counts, _KEPT.format(least=min_documents), "lang string, source string, term string, n long, lead int", shards), "kept")
    groups = docs.groupBy("lang", "source").agg(F.lit(0).alias("n"), F.lit(0).alias("lead")).unionByName(kept.drop("term"))
    groups = groups.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.sum("lead").alias("lead"))
    whole = groups.groupBy("lang").agg(F.sum("own_n").alias("lang_n"), F.sum("lead").alias("v"))
    groups = scratch.save(groups.drop("lead").join(whole, "lang"), "groups")
    parts = scratch.save(by_shard(kept.drop("lead").join(groups, ["lang", "source"]), _PARTS.format(top=top), "kind int, lang string, source string, item string, c long, value long", shards), "parts")

    ours = groups.where("v > 0").selectExpr("lang", "source", "own_n", "v", f"{_p('0', 'own_n')} AS p0")
    theirs = ours.selectExpr("lang", "source AS item", "p0 AS q0")
    far = "source <> item"
    absent = ours.join(theirs, "lang").where(far).selectExpr("lang", "source", "item", f"v * {_f('p0', 'q0')} AS value")
    held = parts.where("kind = 1").groupBy("lang", "source", "c").agg(F.sum("value").alias("n_terms"))
    held = held.join(ours, ["lang", "source"]).selectExpr("lang", "source", "n_terms", "p0", f"{_p('c', 'own_n')} AS p")
    one = held.join(theirs, "lang").where(far).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n_terms * ({_f('p', 'q0')} - {_f('p0', 'q0')})")).alias("value"))
    both = parts.where("kind = 0").select("lang", "source", "item", "value")
    swapped = lambda df: df.selectExpr("lang", "item AS source", "source AS item", "value")
    none = groups.where("v = 0").select("lang", "source")
    none = none.join(none.withColumnRenamed("source", "item"), "lang").where(far).withColumn("value", F.lit(0).cast("long"))
    sums = absent
    for more in (one, swapped(one), both, swapped(both), none):
        sums = sums.unionByName(more)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = parts.where("kind = 2").select("lang", "source", "item", "value").withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, sum(n) AS own_n FROM n GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
    1 + (CAST(coalesce(n.n, 0) + 2 AS HUGEINT) * 1000000000) // (coalesce(own_n, 0) + 2 * v) AS p,
    1 + (CAST(lang_count + 2 AS HUGEINT) * 1000000000) // (lang_n + 2 * v) AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang
    LEFT JOIN own ON g.lang = own.lang AND g.source = own.source LEFT JOIN n ON g.lang = n.lang AND g.source = n.source AND k.term = n.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
