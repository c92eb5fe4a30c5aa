"""Roll-ups of transfers and case tables.  All aggregate with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgertide.functions.expressions import percentage, wilson


def money(total: Column) -> Column:
    return total.cast("double")


def total_drained(transfers: DataFrame, seeds: Column) -> DataFrame:
    """One row: the seeds' outflow, null if nothing is priced, and the same as 0; their count."""
    out = transfers.where(seeds)
    return out.agg(money(F.sum("usd")).alias("usd_or_null"), money(F.coalesce(F.sum("usd"), F.lit(0))).alias("usd"), F.count(F.lit(1)).alias("n_events"))


def edge_rollup(transfers: DataFrame) -> DataFrame:
    """Per (src, dst, chain): sum, count, first and last time, and the token of the largest single
    transfer (the smallest token where several are equal)."""
    largest = F.max_by("token", F.struct("usd", -F.col("token")))
    return transfers.groupBy("src", "dst", "chain").agg(money(F.sum("usd")).alias("usd"), F.count(F.lit(1)).alias("n"), F.min("block_time").alias("first_time"), F.max("block_time").alias("last_time"), largest.alias("top_token"))


def node_rollup(transfers: DataFrame) -> DataFrame:
    """Inflow and outflow of each node, in one shuffle."""
    legs = transfers.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(False).alias("inbound"), "usd"), F.struct(F.col("dst").alias("node"), F.lit(True).alias("inbound"), "usd"))).alias("leg")).select("leg.*")
    return legs.groupBy("node").agg(money(F.coalesce(F.sum(F.when(F.col("inbound"), F.col("usd"))), F.lit(0))).alias("usd_in"), money(F.coalesce(F.sum(F.when(~F.col("inbound"), F.col("usd"))), F.lit(0))).alias("usd_out"), F.count(F.lit(1)).alias("n_legs"))


def labelled_endpoints(labelled: DataFrame) -> DataFrame:
    """Per labelled destination: name, sum, count, first and last time, distinct transactions."""
    return labelled.groupBy("dst").agg(F.min("name").alias("name"), money(F.sum("usd")).alias("usd"), F.count(F.lit(1)).alias("n"), F.min("block_time").alias("first_time"), F.max("block_time").alias("last_time"), F.count_distinct("tx_hash").alias("n_tx"))


def counterparty_expansion(transfers: DataFrame, cap: int) -> DataFrame:
    """Per (src, dst): sum, count, distinct tokens, first and last day; the cap largest of each src by
    (sum, count), and how many counterparties were cut."""
    pairs = transfers.groupBy("src", "dst").agg(F.sum("usd").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("n_tokens"), F.min("block_time").alias("first_time"), F.max("block_time").alias("last_time"))
    by = Window.partitionBy("src")
    ranked = pairs.withColumn("place", F.row_number().over(by.orderBy(F.desc("total"), F.desc("n"), "dst"))).withColumn("all", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("place") <= cap).select("src", "dst", money(F.col("total")).alias("usd"), "n", "n_tokens", "first_time", "last_time", F.col("place").cast("long").alias("place"), F.greatest(F.col("all") - cap, F.lit(0)).alias("n_cut"))


def grouped_totals(transfers: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by each key alone and over all, in one pass (grouping sets)."""
    return transfers.groupingSets([[F.col(k)] for k in keys] + [[]], *keys).agg(money(F.sum("usd")).alias("usd"), F.count(F.lit(1)).alias("n"))


def attribution_coverage(transfers: DataFrame, labels: DataFrame) -> DataFrame:
    """Inflow by destination's label: share of value and of count that is labelled."""
    known = labels.select(F.col("address").alias("dst"), F.lit(True).alias("known")).distinct()
    per = transfers.groupBy("dst").agg(F.sum("usd").alias("usd"), F.count(F.lit(1)).alias("n")).join(known, "dst", "left")
    value, count = F.sum(F.when(F.col("known"), F.col("usd")).otherwise(0)), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0))
    return per.agg(money(value).alias("labelled_usd"), money(F.sum("usd")).alias("usd"), count.alias("labelled_n"), F.sum("n").alias("n"), F.round(percentage(value.cast("double"), F.sum("usd").cast("double")), 6).alias("pct_usd"), F.round(percentage(count.cast("double"), F.sum("n").cast("double")), 6).alias("pct_n"))


def endpoint_diversity(transfers: DataFrame, high: int) -> DataFrame:
    """Distinct counterparties in and out of each node that has both; infra if both reach high."""
    inbound = transfers.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("n_in"))
    outbound = transfers.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n_out"))
    return inbound.join(outbound, "node").withColumn("is_infra", (F.col("n_in") >= high) & (F.col("n_out") >= high))


def dust_fan_out(transfers: DataFrame, dust_usd: float, least: int, ratio: int) -> DataFrame:
    """Sources with least or more distinct dust destinations and ratio times the others."""
    dust = F.col("usd") < F.lit(dust_usd).cast("decimal(18,4)")
    per = transfers.groupBy("src").agg(F.count_distinct(F.when(dust, F.col("dst"))).alias("n_dust"), F.count_distinct(F.when(~dust, F.col("dst"))).alias("n_other"))
    return per.where((F.col("n_dust") >= least) & (F.col("n_dust") >= ratio * F.col("n_other")))


def direct_risk(exposures: DataFrame, cap: int = 5) -> DataFrame:
    """(address, counterparty, direction, severity, usd) -> score per address: severity times
    exposures of a dollar or more, at most cap of each counterparty and direction."""
    per = exposures.groupBy("address", "counterparty", "direction", "severity").agg(F.sum("usd").alias("usd"), F.count_if(F.col("usd") >= 1).alias("n"))
    out = per.groupBy("address").agg(F.sum(F.col("severity") * F.least(F.col("n"), F.lit(cap))).cast("long").alias("score"), money(F.sum("usd")).alias("usd"), F.count_distinct("counterparty").alias("n_risky"), F.bool_or(F.col("severity") == 3).alias("any_severe"))
    return out.withColumn("verdict", F.when(F.col("any_severe") | (F.col("score") >= 20), "high").when(F.col("score") >= 6, "medium").when(F.col("score") > 0, "low").otherwise("none"))


def strongest_outcome(outcomes: DataFrame, strength: dict[str, int]) -> DataFrame:
    """The strongest outcome of each letter; the latest of equals."""
    rank = F.lit(99)
    for name, place in strength.items():
        rank = F.when(F.col("outcome_type") == name, place).otherwise(rank)
    by = Window.partitionBy("letter_id").orderBy(rank, F.desc("observed_at"), "seq")
    return outcomes.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")


def issuer_priors(letters: DataFrame, strongest: DataFrame, wins: tuple[str, ...], alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Per (issuer, tier): letters with an outcome, wins, posterior mean of a Beta prior, and the
    mean hours of response."""
    joined = strongest.join(letters, "letter_id")
    hours = F.expr("timestampdiff(HOUR, sent_at, observed_at)").cast("double")
    won = F.count_if(F.col("outcome_type").isin(*wins))
    n = F.count(F.lit(1))
    return joined.groupBy("issuer", "tier").agg(n.alias("n"), won.alias("wins"), F.round((won + alpha) / (n + alpha + beta), 9).alias("posterior"), F.round(F.avg(hours), 6).alias("mean_hours"), F.median(hours).alias("median_hours"))


def trimmed(values: DataFrame, group: list[str], value: str, least: int, share: int = 10, cells: int = 256) -> DataFrame:
    """Mean and median without the n // share smallest and largest (one at least) of each group; plain
    below least values.  Nulls are no values.

    A group's distinct values are ranked cell by cell; the cells' bounds are approximate
    quantiles, so that no group is one task, and the ranks are exact.
    """
    filled = values.where(F.col(value).isNotNull())
    bounds = filled.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, [k / cells for k in range(1, cells)], 100 * cells).alias("bounds"))
    tied = filled.groupBy(*group, value).agg(F.count(F.lit(1)).alias("times")).join(bounds, group)
    tied = tied.withColumn("cell", F.size(F.filter("bounds", lambda b: b < F.col(value)))).drop("bounds")
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = tied.groupBy(*group, "cell").agg(F.sum("times").alias("held")).withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = Window.partitionBy(*group, "cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = tied.withColumn("upto", F.sum("times").over(inside)).join(starts, [*group, "cell"])
    low, high = F.col("start") + F.col("upto") - F.col("times"), F.col("start") + F.col("upto")
    cut = F.when(F.col("n") < least, 0).otherwise(F.greatest(F.floor(F.col("n") / share), F.lit(1)))
    kept = F.least(high, F.col("n") - cut) - F.greatest(low, cut)
    at = lambda place: F.max(F.when((low < place) & (place <= high), F.col(value)))
    # both ends lose as many, so the middle stays where it is
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    mean = F.sum(F.when(kept > 0, F.col(value) * kept)) / F.sum(F.when(kept > 0, kept))
    return placed.groupBy(*group, "n").agg(F.round(mean, 6).alias("trimmed_mean"), F.round(middle, 6).alias("trimmed_median")).where("trimmed_mean IS NOT NULL")


def win_interval(letters_outcomes: DataFrame, wins: tuple[str, ...]) -> DataFrame:
    """Wilson interval of each issuer's share of wins."""
    per = letters_outcomes.groupBy("issuer").agg(F.count("outcome_type").alias("n"), F.count_if(F.col("outcome_type").isin(*wins)).alias("wins"))
    low, high = wilson(F.col("wins").cast("double"), F.col("n").cast("double"))
    return per.select("issuer", "n", "wins", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))
