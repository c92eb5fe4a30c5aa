"""Operator 3, URL filters: host and path rules first, then a ratio of two character
language models.

Both models are variable-order Markov models over the bytes of host and path: the counts
of each context of 0 to ``ORDER`` bytes are backed by those of the next shorter one with
weight ``MU`` (Dirichlet smoothing).  They learn from every URL on which a rule decides;
a byte with its context is a whole number, so that counts are exact tables that grow with
the input, joined to the n-grams of the pages.  A tenth of the labelled URLs is kept apart,
and the bound of the difference of mean log-likelihoods that best parts its accepted from
its rejected is the verdict's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import Slice, slices
from ledgertide.llm.shared import Scratch, fold_ascii, table

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 5
#: A byte plus one, or 0 before the text.
BYTE_BITS = 9
#: Rows that are scored together.
CHUNK_ROWS = 5000
MU = 4.0
BINS = 4000
REACH = 10.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first '://' up to '/', '?', '#' or the end, then
    up to '?', '#' or the end; both empty without '://' or url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return fold_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name and verdict of the longest rule that fits (null: none does)."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def grams(piece: Slice) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its text, the byte in the lowest BYTE_BITS."""
    data = piece.data.astype(np.int64) + 1
    n = len(data)
    since = np.arange(n) - np.repeat(piece.offsets[:-1], np.diff(piece.offsets))
    out = data.copy()
    for k in range(1, min(ORDER, n - 1) + 1):
        out[k:] |= np.where(since[k:] >= k, data[:-k], 0) << (k * BYTE_BITS)
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """texts: (label int 0 or 1, text) -> gram, c0, c1: how often each gram stands in each label's
    texts, of all rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy()
            for piece in slices(batch.column(1)):
                label = np.repeat(labels[piece.rows], np.diff(piece.offsets))
                own, at = np.unique(grams(piece), return_inverse=True)
                counts = [np.bincount(at[label == which], minlength=len(own)).astype(np.int64) for which in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, counts)], ["gram", "c0", "c1"])

    return texts.mapInArrow(gather, "gram long, c0 long, c1 long").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def likelihoods(needed: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """needed (gram, distinct) and counts -> gram, p0, p1: the probability of its byte after its
    context under each model.  From the shortest context on; what no text has counts 0."""
    cut = lambda c, k: F.col(c).bitwiseAND((1 << (k + 1) * BYTE_BITS) - 1)
    wanted, seen = {ORDER: needed}, {ORDER: counts}
    for k in range(ORDER - 1, -1, -1):
        wanted[k] = scratch.save(wanted[k + 1].select(cut("gram", k).alias("gram")).distinct(), f"wanted{k}")
        seen[k] = scratch.save(seen[k + 1].groupBy(cut("gram", k).alias("gram")).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), f"seen{k}")
    known = None
    for k in range(ORDER + 1):
        context = F.shiftright("gram", BYTE_BITS).alias("context")
        alone = seen[k].groupBy(context).agg(F.sum("c0").alias("a0"), F.sum("c1").alias("a1"))
        rows = wanted[k].join(seen[k], "gram", "left").withColumn("context", context).join(alone, "context", "left").withColumn("shorter", cut("gram", k - 1) if k else F.lit(0))
        if known is None:
            rows = rows.withColumn("p0", F.lit(1 / 256)).withColumn("p1", F.lit(1 / 256))
        else:
            rows = rows.join(known.withColumnRenamed("gram", "shorter"), "shorter")
        count = lambda c: F.coalesce(c, F.lit(0))
        p = [((count(f"c{m}") + MU * F.col(f"p{m}")) / (count(f"a{m}") + MU)).alias(f"p{m}") for m in (0, 1)]
        known = scratch.save(rows.select("gram", *p), f"known{k}")
    return known


def ratios(pages: DataFrame, labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """pages (any columns, text) and labelled (label, text) -> the columns of pages but text, and
    ratio: mean log-likelihood under the accepted less that under the rejected (0 for an empty
    text).  Rows are cut into chunks, each of which meets its own grams' likelihoods."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields]
    kept = [c for c in pages.columns if c != "text"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, chunk))], [*batch.schema.names, "chunk"])
                chunk += 1

    chunked = scratch.save(pages.mapInArrow(number, ", ".join([*columns, "chunk long"])), "chunked")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                chunk = np.repeat(batch.column(0).to_numpy()[piece.rows], np.diff(piece.offsets))
                all_grams = grams(piece)
                for c in np.unique(chunk):
                    own = np.unique(all_grams[chunk == c])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c)), pa.array(own)], ["chunk", "gram"])

    used = scratch.save(chunked.select("chunk", "text").mapInArrow(gather, "chunk long, gram long"), "used")
    counts = scratch.save(count_grams(labelled), "counts")
    needed = scratch.save(used.select("gram").distinct(), "needed")
    known = likelihoods(needed, counts, scratch).select("gram", (F.log("p1") - F.log("p0")).alias("gain"))
    gains = used.join(known, "gram").select("chunk", "gram", "gain")

    def score(rows: pa.Table, own: pa.Table) -> pa.Table:
        order = np.argsort(own["gram"].to_numpy())
        table_, gain = own["gram"].to_numpy()[order], own["gain"].to_numpy()[order]
        ratio = np.zeros(rows.num_rows)
        for piece in slices(rows["text"]):
            sums = np.concatenate([[0.0], np.cumsum(gain[np.searchsorted(table_, grams(piece))])])
            ratio[piece.rows] = (sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]) / np.maximum(np.diff(piece.offsets), 1)
        return rows.select(kept).append_column("ratio", pa.array(ratio))

    schema = ", ".join([c for c, name in zip(columns, pages.columns, strict=True) if name != "text"] + ["ratio double"])
    return chunked.groupBy("chunk").cogroup(gains.groupBy("chunk")).applyInArrow(score, schema)


def calibrate(ratio: DataFrame) -> float:
    """(label, ratio) -> the bound with the best mean of both labels' hit rates; 0 where one
    label is missing."""
    edge = 2 * REACH / BINS
    binned = ratio.groupBy("label", F.floor((F.least(F.greatest("ratio", F.lit(-REACH)), F.lit(REACH)) + REACH) / edge).alias("bin")).count().collect()  # 2 * (BINS + 1) rows at most
    tally = np.zeros((2, BINS + 1))
    for r in binned:
        tally[r.label, min(int(r.bin), BINS)] += r["count"]
    if not tally.sum(1).all():
        return 0.0
    below = np.cumsum(np.pad(tally, ((0, 0), (1, 0))), axis=1)[:, :-1] / tally.sum(1, keepdims=True)
    gain = below[0] + 1 - below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] * edge - REACH)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, ratio, a row for each row.

    A rule fits its host and all subdomains where the path starts with the rule's; the
    longest decides.  Elsewhere the verdict is allow if the ratio is at or over the
    calibrated bound.  A url without a host (also null) that no rule fits is blocked.  Repeated
    rows each count and are each judged; other columns are ignored, whatever their names; an
    empty table gives one.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("url"), F.lit(10)).alias("fold"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), RULES if rules is None else rules)
    split = split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), "fold", F.concat("host", "path").alias("text"))
    label = (F.col("ruled") == "allow").cast("int").alias("label")
    scratch = Scratch(pages.sparkSession, "urls")
    judged = scratch.save(ratios(split, split.where("ruled IS NOT NULL AND fold <> 0").select(label, "text"), scratch), "judged")
    bound = calibrate(judged.where("ruled IS NOT NULL AND fold = 0").select(label, "ratio"))
    by_model = F.when((F.col("host") != "") & (F.col("ratio") >= bound), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "ratio")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every page."""
    return judge_urls(table(spark, sf_dir, "pages"))
