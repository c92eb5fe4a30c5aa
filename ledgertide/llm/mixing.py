"""Operator 8, mixing sources to target weights by Poisson replication, with DataFrame
functions only.

A source's mean repetition is its target share of the output over its share of the input.
Each document draws its count by inverting the Poisson distribution of that mean at a
number hashed from the seed and its doc_id, is exploded by it, and all copies are dealt
and sorted by a hash: the same rows in the same order whatever the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.shared import Scratch, table

#: Target shares of the output; sources that aren't named share the rest by their size.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1}
SEED = 17
#: Means above this are drawn as a sum of equal parts, so that exp(-mean) stays a number.
PART = 256.0
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1): the first 52 bits of an md5."""
    key = F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is far below 2**-52."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["all"], acc["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def source_means(docs: DataFrame, weights: dict[str, float], total: float = 1.0) -> DataFrame:
    """source (null as ''), n_docs, mean: the repetitions that give the target shares."""
    counts = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    named = F.lit(None).cast("double")
    for name, weight in weights.items():
        named = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(named)
    counts = counts.withColumn("named", named)
    sums = counts.agg(F.sum("n_docs").alias("all_docs"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("all_named"), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("n_docs"))), F.lit(0)).alias("others"))
    joined = counts.crossJoin(F.broadcast(sums))  # one row
    # where only named sources are present, or they ask for more than everything, shares are relative
    rest = F.when(F.col("others") > 0, F.greatest(1 - F.col("all_named"), F.lit(0.0))).otherwise(F.lit(0.0))
    share = F.coalesce("named", rest * F.col("n_docs") / F.col("others")) / (F.col("all_named") + rest)
    return joined.select("source", "n_docs", (share * F.col("all_docs") * total / F.col("n_docs")).alias("mean"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, total: float = 1.0) -> DataFrame:
    """All columns of docs, with ``replica`` (1, 2, ...) and ``shuffle_key`` (by which the rows
    lie in random order), where docs has no columns of these names.

    About total * rows come back; a document may come several times or not at all.  A null
    source counts as ''.  The draw depends on the seed and doc_id alone: rows with the same
    doc_id and source are drawn alike; a null doc_id counts as 'null'.  Texts aren't looked
    at.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    means = source_means(docs, WEIGHTS if weights is None else weights, total)
    parts = F.greatest(F.ceil(F.col("mean") / PART).cast("int"), F.lit(1))
    means = means.select("source", parts.alias("parts"), (F.col("mean") / parts).alias("mean"))
    means = scratch.save(means.select(F.struct(F.col("source").alias("key"), "parts", poisson_cdf(F.col("mean")).alias("cdf")).alias("drawn as")), "means")
    small = means.count() <= BROADCAST_SOURCES
    names = docs.columns
    joined = docs.join(F.broadcast(means) if small else means, F.coalesce(docs["source"], F.lit("")) == F.col("drawn as.key"))
    doc_key = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    cdf = F.col("drawn as.cdf")

    def draw(total: Column, part: Column) -> Column:
        u = uniform("draw", seed, part.cast("string"), doc_key)
        return total + F.get(F.transform(F.array(u), lambda x: F.size(F.filter(cdf, lambda c: c <= x))), F.lit(0))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("drawn as.parts")), F.lit(0), draw)
    joined = joined.withColumn("copies drawn", copies).where(F.col("copies drawn") > 0)
    joined = joined.select(*(docs[c] for c in names), F.explode(F.sequence(F.lit(1), F.col("copies drawn"))).alias("replica drawn"))
    key = F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), F.col("replica drawn").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    dealt = joined.withColumn("place drawn", key).repartition("place drawn").sortWithinPartitions("place drawn")
    extra = [F.col(a).alias(b) for a, b in (("replica drawn", "replica"), ("place drawn", "shuffle_key")) if b not in names]
    return dealt.select(*names, *extra)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, replica, shuffle_key, text of every copy."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "replica", "shuffle_key", "text")


def mixing_sql(documents: str, seed: int = SEED) -> str:
    """CTEs that end in ``mixed``, over the relation ``documents``."""
    named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
    return f"""
counts AS (
  SELECT coalesce(source, '') AS source, count(*) AS n, CASE coalesce(source, '') {named} END AS named FROM {documents} GROUP BY ALL),
sums AS (
  SELECT sum(n) AS all_docs, coalesce(sum(named), 0) AS all_named, coalesce(sum(n) FILTER (WHERE named IS NULL), 0) AS others FROM counts),
rested AS (SELECT *, CASE WHEN others > 0 THEN greatest(1 - all_named, 0) ELSE 0 END AS rest FROM sums),
means AS (
  SELECT source, coalesce(named, rest * n / others) / (all_named + rest) * all_docs / n AS mean FROM counts, rested),
terms AS (
  SELECT source, mean, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1)) END AS p
  FROM means, range(0, 400) AS t(k)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
lists AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, CAST('0x' || substr(md5('draw:{seed}:1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM {documents} d),
mixed AS (
  SELECT drawn.*, unnest(range(1, 1 + len(list_filter(cs, lambda c: c <= u)))) AS replica
  FROM drawn JOIN lists ON coalesce(drawn.source, '') = lists.source)"""


OP8_SQL = f"""
WITH {mixing_sql("documents").strip()}
SELECT doc_id, source, CAST(replica AS INTEGER) AS replica,
       md5('order:{SEED}:' || replica || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle_key, text
FROM mixed
"""
