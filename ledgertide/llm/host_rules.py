"""Operator 5, quality rules by host, with DataFrame functions only.

Each text's measures come from one pass of built-in array functions.  A host's failures
of each rule are summed, its rate is shrunk towards a beta prior that all hosts give
(method of moments), and a host whose shrunken rate is over the rule's bound is rejected
with all its documents.  Only counts by host are shuffled (pre-aggregated, so that a host
with a third of all documents costs a row a task), and only rejected hosts are joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.shared import Scratch, join_small, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected where its shrunken failure rate of a rule is over this.
HOST_BOUNDS = {"short": 0.8, "repetitive": 0.5, "symbols": 0.5, "dup_lines": 0.5}
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of anything but ASCII white space."""
    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    def marked(windows: Column) -> Column:
        """windows: (hash, place), sorted."""
        twins = F.filter(windows, lambda x, i: (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(twins, lambda x: x["p"])), covered)

    def by_hash(hashes: Column) -> Column:
        repeats = let(F.sort_array(hashes), lambda s: F.exists(F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("a"), F.slice(s, 2, F.size(s) - 1).alias("b")), lambda x: x["a"] == x["b"]))
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(repeats, let(windows, marked)).otherwise(F.lit(0).cast("long"))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 4, let(hashes, by_hash)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    line_counts = let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.struct(F.size(h).cast("long").alias("n"), (F.size(h) - F.size(F.array_distinct(h))).cast("long").alias("dup")))
    return let(
        words_of(text),
        lambda w: let(
            line_counts,
            lambda c: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                c["dup"].alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                c["n"].alias("n_lines"),
            ),
        ),
    )


def rule_failures(m: dict[str, Column]) -> dict[str, Column]:
    """Rule -> whether a document fails it, from its measures."""
    return {
        "short": m["n_words"] < MIN_WORDS,
        "repetitive": 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["word_chars"],
        "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """source, n_docs, rate_<rule> (shrunken) and rejected, of each source that isn't null.

    The prior of a rule: mean m of the hosts' rates, their variance v less the part that
    sampling explains, m (1 - m) avg(1/n); strength m (1 - m) / that - 1, kept within
    1 and 1e6 (no spread at all: all hosts are taken as one).
    """
    rules = rule_failures({c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")})
    hosts = measured.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(failed.cast("long")).alias(f"f_{k}") for k, failed in rules.items()))
    prior = hosts.agg(F.avg(1 / F.col("n_docs")).alias("noise"), *(g(F.col(f"f_{k}") / F.col("n_docs")).alias(f"{p}_{k}") for k in rules for p, g in (("m", F.avg), ("v", F.var_pop))))
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    rates = {}
    for k in rules:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        between = v - m * (1 - m) * F.col("noise")
        strength = F.when(between > 0, F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
        rates[k] = (F.col(f"f_{k}") + m * strength) / (F.col("n_docs") + strength)
    rejected = F.lit(False)
    for k, rate in rates.items():
        rejected = rejected | (rate > HOST_BOUNDS[k])
    return joined.select("source", "n_docs", *(rate.alias(f"rate_{k}") for k, rate in rates.items()), rejected.alias("rejected"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, the measures, base_failed, host_rejected and
    kept, a row for each row.

    Null and empty texts have no words and fail.  A null source is no host: its documents
    are judged by their own failures.  Rows are judged one by one, also where doc_ids
    repeat.  Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "hosts")
    measured = docs.select("doc_id", "source", measures(F.col("text")).alias("m")).select("doc_id", "source", "m.*")
    measured = scratch.save(measured, "measured")
    bad = scratch.save(host_rates(measured).where("rejected").select("source", F.lit(True).alias("host_rejected")), "rejected")
    failed = rule_failures({c: F.col(c) for c in MEASURES})
    judged = join_small(measured, bad, "source").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    judged = judged.withColumn("base_failed", failed["short"] | failed["repetitive"])
    return judged.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (all their columns) that judge keeps.

    The rows are written once with their measures, which cost far more than a copy of the
    text, and read again when the hosts' rates are known; no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "hosts")
    own = "measures"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    host = own + "_host"
    measured = scratch.save(docs.withColumn(own, measures(F.col("text"))), "measured")
    m = F.col(own)
    bad = scratch.save(host_rates(measured.select("source", f"{own}.*")).where("rejected").select(F.col("source").alias(host)), "rejected")
    failed = rule_failures({c: m[c] for c in MEASURES})
    kept = measured.where(~(failed["short"] | failed["repetitive"])).select(*docs.columns)
    if not bad.head(1):
        return kept
    small = bad.count() <= 50_000
    return kept.join(F.broadcast(bad) if small else bad, F.col("source") == F.col(host), "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures, base_failed, kept, host_rejected of every document."""
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


MEASURES_SQL = r"""
words AS (
  SELECT doc_id, source, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM words WHERE len(w) >= 3),
keyed AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM grams),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.n - lines.d, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive,
         10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM measured),
rates AS (
  SELECT source, count(*) AS n, unnest(['short', 'repetitive', 'symbols', 'dup_lines']) AS rule, unnest([0.8, 0.5, 0.5, 0.5]) AS bound,
         unnest([count(*) FILTER (WHERE short), count(*) FILTER (WHERE repetitive), count(*) FILTER (WHERE symbols), count(*) FILTER (WHERE dup_lines)]) AS f
  FROM ruled WHERE source IS NOT NULL GROUP BY source),
prior AS (
  SELECT rule, avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS b FROM rates GROUP BY rule),
strong AS (
  SELECT rule, m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM prior),
hosts AS (
  SELECT source, bool_or((f + m * s) / (n + s) > bound) AS rejected FROM rates JOIN strong USING (rule) GROUP BY source)"""

OP5_SQL = f"""
WITH {MEASURES_SQL.strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive OR coalesce(rejected, false)) AS kept, coalesce(rejected, false) AS host_rejected
FROM ruled LEFT JOIN hosts USING (source)
"""
