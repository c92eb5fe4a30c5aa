"""Joins of transfers with each other and with dimensions.

Joins over a range of time go by ``within``: the rows of a key are dealt over buckets of
time, so a busy account doesn't meet itself in one task and no pair outside the range's
two buckets is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions.expressions import decayed_confidence, is_placeholder

DAY_ZERO = "1970-01-01"


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, days: int, near: tuple[str, str, float] | None = None) -> DataFrame:
    """Pairs of equal keys with 0 <= right_time - left_time <= days, as column ``days``.  But for
    keys the column names must differ.

    near: (left value, right value, percent) where pairs of which the right value is farther
    than that from the left one are of no use: values are dealt over bands of their
    logarithm too, so that a key of few values (a symbol, an exchange) isn't quadratic.
    """
    width = days + 1
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit(DAY_ZERO)) / width)
    spread = left.withColumn("bucket", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    other, on = right.withColumn("bucket", bucket(right_time)), [*keys, "bucket"]
    if near is not None:
        mine, theirs, percent = near
        size = log((100 + percent) / (100 - percent)) * 1.000001 + 1e-9
        low = F.floor((F.ln(F.col(mine).cast("double") * (100 - percent) / 100) - 1e-9) / size)
        spread = spread.where(F.col(mine) > 0).withColumn("band", F.explode(F.array(low, low + 1)))
        other, on = other.where(F.col(theirs) > 0).withColumn("band", F.floor(F.ln(F.col(theirs).cast("double")) / size)), [*on, "band"]
    pairs = spread.join(other, on)
    return pairs.withColumn("days", F.datediff(right_time, left_time)).where(F.col("days").between(0, days)).drop("bucket", "band")


#: Pairs of legs that are added up at once.
PAIRS_AT_ONCE = 1_000_000


def party_pairs(out: DataFrame, back: DataFrame, days: int, blocks: int) -> DataFrame:
    """chain, sender, recipient, n: how many legs out and back on a chain follow each other in 1 to days
    days, for any two different parties.  out: chain, sender, out_time; back: chain, recipient, in_time.

    The result is quadratic by nature, but no pair is shuffled and no leg is written twice: parties are
    dealt over blocks, a task for every two blocks reads both from where they lie once, and all pairs of two parties
    are added up there.  A block holds a number for a party and day, and a pair of blocks gives its
    rows in bounded batches.
    """

    def side(legs: DataFrame, party: str, time: str) -> DataFrame:
        legs = legs.select("chain", F.col(party), F.datediff(F.col(time), F.lit(DAY_ZERO)).alias("day")).where(f"chain IS NOT NULL AND {party} IS NOT NULL AND day IS NOT NULL")
        legs = legs.withColumn("block", F.pmod(F.xxhash64(party), F.lit(blocks))).repartition(max(blocks, cores), "chain", "block")
        counted = legs.groupBy("chain", "block", party, "day").agg(F.count(F.lit(1)).alias("n"))
        block = counted.groupBy("chain", "block").agg(*(F.collect_list(c).alias(f"{party}_{c}") for c in (party, "day", "n")))  # a block is bounded
        return block.repartitionByRange(blocks, "block", "chain").drop("block")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chain, *lists = (batch.column(c)[i] for c in range(7))
                for sender, recipient, n in pair_counts(*(x.values.to_numpy() for x in lists), days):
                    yield pa.RecordBatch.from_arrays([pa.repeat(chain, len(n)), pa.array(sender), pa.array(recipient), pa.array(n)], ["chain", "sender", "recipient", "n"])

    cores = out.sparkSession.sparkContext.defaultParallelism
    blocks = max(blocks, ceil(sqrt(2 * cores)))  # every core has a pair of blocks
    met = side(out, "sender", "out_time").hint("shuffle_replicate_nl").join(side(back, "recipient", "in_time"), "chain")
    kind = dict(out.dtypes)["chain"]
    return met.select("chain", *(f"{x}_{c}" for x in ("sender", "recipient") for c in (x, "day", "n"))).mapInArrow(added, f"chain {kind}, sender long, recipient long, n long")


def pair_counts(sender: np.ndarray, out_day: np.ndarray, n_out: np.ndarray, recipient: np.ndarray, in_day: np.ndarray, n_back: np.ndarray, days: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of n_out * n_back by sender and another recipient where in_day is 1 to days after out_day."""
    order = np.argsort(in_day, kind="stable")
    in_day, n_back = in_day[order], n_back[order]
    names, place = np.unique(recipient[order], return_inverse=True)
    low, high = np.searchsorted(in_day, out_day + 1, "left"), np.searchsorted(in_day, out_day + days, "right")
    rows = np.flatnonzero(high > low)
    rows = rows[np.argsort(sender[rows], kind="stable")]
    low, size, n_out = low[rows], (high - low)[rows], n_out[rows]
    parties, who = np.unique(sender[rows], return_inverse=True)
    begins = np.append(np.searchsorted(who, np.arange(len(parties))), len(who))  # of a sender's rows
    before = np.append(0, np.cumsum(size))[begins]  # pairs before a sender's
    first = 0
    while first < len(parties):
        last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS_AT_ONCE, "right")) - 1)
        own = slice(begins[first], begins[last])
        times = size[own]
        at = np.arange(before[last] - before[first]) + np.repeat(low[own] - (np.cumsum(times) - times), times)
        cell = np.repeat((who[own] - first) * len(names), times) + place[at]
        value = np.repeat(n_out[own], times) * n_back[at]
        cells = (last - first) * len(names)
        if cells <= 16 * len(cell):
            total = np.zeros(cells, np.int64)
            np.add.at(total, cell, value)
            hit = np.flatnonzero(total)
            total = total[hit]
        else:
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            hit, total = cell[starts], np.add.reduceat(value[order], starts)
        one, other = parties[first + hit // len(names)], names[hit % len(names)]
        differ = one != other
        yield one[differ], other[differ], total[differ]
        first = last


def totals_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, days: int, left_value: str, right_value: str, apart: tuple[str, str] | None = None) -> DataFrame:
    """left with n, total and first: the count, sum of right_value and earliest right_time of the right rows
    of equal keys with 0 <= right_time - left_time <= days and right_value <= left_value; rows
    with none are left out.  But for keys the column names must differ.

    apart: (left column, right column) that must differ.  No pair is made: a left row meets the
    days (and values of apart) that the key has, and among a day's rows, sorted by value, the
    running totals below it.  So the work is that of the rows times the days, also where a
    key holds a third of them.
    """
    day = lambda c: F.to_date(F.col(c))
    group = [*keys, "at", *([apart[1]] if apart else [])]
    held = right.withColumn("at", day(right_time))
    rows = left.withColumn("row", F.monotonically_increasing_id())
    rows = settled_ids(rows)
    spans = within(rows.select(*keys, "row", left_time, left_value, *([apart[0]] if apart else [])), held.select(*group).distinct().withColumn("at_time", F.col("at").cast("timestamp_ntz")), keys, left_time, "at_time", days)
    if apart:
        spans = spans.where(F.col(apart[0]) != F.col(apart[1]))
    asked = spans.select(*group, F.col(left_value).alias("value"), F.lit(1).alias("kind"), "row")
    given = held.select(*group, F.col(right_value).alias("value"), F.lit(0).alias("kind"), F.col(right_value).alias("part"), F.col(right_time).alias("seen"))
    below = Window.partitionBy(*group).orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    running = given.unionByName(asked, allowMissingColumns=True).select("row", "kind", F.count("part").over(below).alias("n"), F.sum("part").over(below).alias("total"), F.min("seen").over(below).alias("first"))
    sums = running.where("kind = 1 AND n > 0").groupBy("row").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first").alias("first"))
    return rows.join(sums, "row").drop("row")


def settled_ids(rows: DataFrame) -> DataFrame:
    """Rows whose ids are read twice: written once, so that both readings agree."""
    from ledgertide.operators.graph import settle

    return settle(rows)


def parts_per_million(part: Column, whole: Column) -> Column:
    """|part| in millionths of whole, rounded down."""
    return F.floor(F.abs(part).cast("double") * 1_000_000 / whole.cast("double"))


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key, numbered in ``place`` (long)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def label_lookup(transfers: DataFrame, labels: DataFrame, now: Column) -> DataFrame:
    """Left join by destination, with the confidence as it has decayed until ``now``."""
    known = labels.select(F.col("address").alias("dst"), "name", "category", decayed_confidence(F.col("confidence"), F.col("added_at"), now).alias("confidence"))
    return transfers.join(known, "dst", "left")


def label_in_force(label_time: dict[str, Column], at: Column) -> Column:
    """Whether a label was known and valid at a time; a null bound is open."""
    return (label_time["added_at"].isNull() | (label_time["added_at"] <= at)) & (label_time["valid_from"].isNull() | (label_time["valid_from"] <= at)) & (label_time["valid_until"].isNull() | (label_time["valid_until"] >= at))


def point_in_time_labels(transfers: DataFrame, labels: DataFrame) -> DataFrame:
    """Every transfer with its destination's label of that moment (null: none then), its
    confidence as decayed by then."""
    known = labels.withColumnRenamed("address", "dst")
    hit = label_in_force({c: F.col(c) for c in ("added_at", "valid_from", "valid_until")}, F.col("block_time"))
    joined = transfers.join(known, "dst", "left").withColumn("hit", F.coalesce(hit & F.col("name").isNotNull(), F.lit(False)))
    return joined.select(
        *transfers.columns,
        F.when(F.col("hit"), F.col("name")).alias("name"),
        F.when(F.col("hit"), F.col("category")).alias("category"),
        F.when(F.col("hit"), decayed_confidence(F.col("confidence"), F.col("added_at"), F.col("block_time"))).alias("confidence"),
    )


def priced(transfers: DataFrame, daily: DataFrame, fallback: DataFrame) -> DataFrame:
    """unit_price by (token, day), else the token's fallback, and which of them it is."""
    out = transfers.withColumn("day", F.to_date("block_time")).join(daily, ["token", "day"], "left").join(fallback, "token", "left")
    source = F.when(F.col("price").isNotNull(), "daily").when(F.col("fallback_price").isNotNull(), "fallback").otherwise("none")
    return out.select(*transfers.columns, F.coalesce("price", "fallback_price").alias("unit_price"), source.alias("price_source"))


def two_sided_exposure(transfers: DataFrame, high_risk: DataFrame) -> DataFrame:
    """address, counterparty, direction, severity, usd: outflows flag the sender, inflows the receiver."""
    out = transfers.join(high_risk, transfers.dst == high_risk.address).select(transfers.src.alias("address"), transfers.dst.alias("counterparty"), F.lit("out").alias("direction"), "severity", "usd")
    inflow = transfers.join(high_risk, transfers.src == high_risk.address).select(transfers.dst.alias("address"), transfers.src.alias("counterparty"), F.lit("in").alias("direction"), "severity", "usd")
    return out.unionByName(inflow)


def next_spend(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """outputs (account, at and others) with column ``next``: tx of the account's first spend (account,
    at, tx) at that time or later, the smallest of one time; null where none follows.

    An account's rows are dealt over months, so that a busy one isn't one task; what follows
    a month is carried back to it in a table of a row for each account and month.
    """
    month = F.trunc("at", "month")
    uses = spends.groupBy("account", "at").agg(F.min("tx").alias("tx")).withColumn("month", month)
    rows = outputs.withColumn("month", month).withColumn("use", F.lit(False))
    first = uses.groupBy("account", "month").agg(F.min_by("tx", "at").alias("first"))
    months = rows.select("account", "month").distinct().join(first, ["account", "month"], "full")
    back = Window.partitionBy("account").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("account", "month", F.last("first", ignorenulls=True).over(back).alias("later"))
    here = Window.partitionBy("account", "month").orderBy(F.desc("at"), F.desc("use")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(uses.withColumn("use", F.lit(True)), allowMissingColumns=True)
    placed = both.withColumn("soon", F.last("tx", ignorenulls=True).over(here)).where("NOT use")
    return placed.join(months, ["account", "month"], "left").select(*outputs.columns, F.coalesce("soon", "later").alias("next"))


def position_leads(events: DataFrame, parkers: DataFrame) -> DataFrame:
    """Where value that parkers (chain, tx, parker) put into a position left it: every exit of the
    same position at the same contract, in the block of the parker's first deposit or later,
    one row for each exit and parker.

    That it is the same position is certain (high); who took it is sure only if the receiver is
    the parker (high), for positions change hands (medium).  events: see position_events.
    """
    one = ["chain", "contract", "kind", "position"]
    deposits = events.where("role = 'park'").join(parkers, ["chain", "tx"])
    parks = deposits.groupBy(*one, "parker").agg(F.min(F.struct("block", "tx")).alias("first")).select(*one, "parker", F.col("first.tx").alias("park_tx"), F.col("first.block").alias("park_block"))
    exits = events.where("role = 'exit'").select(*one, F.col("tx").alias("exit_tx"), F.col("log").alias("exit_log"), F.col("block").alias("exit_block"), "recipient", "amount0", "amount1")
    same = F.coalesce(F.col("recipient") == F.col("parker"), F.lit(False))
    pairs = parks.join(exits, one).where("exit_block >= park_block").withColumn("recipient_is_parker", same)
    return pairs.withColumn("link", F.lit("high")).withColumn("actor", F.when(same, "high").otherwise("medium"))


SERVICES = ("exchange", "exchange_deposit", "exchange_hot_wallet", "mixer", "bridge", "dex")


def dormant_holdings(transfers: DataFrame, balances: DataFrame, issued: DataFrame, prices: DataFrame, seeds: DataFrame, labels: DataFrame, least: float = 10_000) -> DataFrame:
    """What addresses that received funds still hold: address, n_holdings, n_unpriced, total_usd, inflow_usd, inflow_count.

    Candidates are receivers of transfers (dst, token, usd) that are no seed (address), no placeholder and
    carry no service's label (address, category).  Of their balances (address, token, amount) count those in a
    token that they received or that an issuer can freeze (issued: token), at today's price
    (token, price); a token without one counts nothing and is told.  Addresses below ``least`` are left out.
    """
    into = transfers.select(F.col("dst").alias("address"), "token", "usd").join(seeds.select("address").distinct(), "address", "left_anti")
    into = into.join(labels.where(F.col("category").isin(*SERVICES)).select("address").distinct(), "address", "left_anti").where(~is_placeholder(F.col("address").cast("string")))
    flows = into.groupBy("address").agg(F.sum("usd").alias("inflow_usd"), F.count(F.lit(1)).alias("inflow_count"))
    seen = into.select("address", "token", F.lit(True).alias("seen")).distinct()
    held = balances.where("amount > 0").join(seen, ["address", "token"], "left").join(issued.select("token", F.lit(True).alias("issued")).distinct(), "token", "left").where("seen OR issued")
    valued = held.join(prices.groupBy("token").agg(F.max("price").alias("price")), "token", "left")
    total = valued.groupBy("address").agg(F.count(F.lit(1)).alias("n_holdings"), F.count_if(F.col("price").isNull()).alias("n_unpriced"), F.sum(F.col("amount") * F.col("price")).alias("total_usd"))
    return total.where(F.col("total_usd") >= least).join(flows, "address").select("address", "n_holdings", "n_unpriced", "total_usd", "inflow_usd", "inflow_count")


def withdrawals_elsewhere(events: DataFrame, wallets: DataFrame) -> DataFrame:
    """Withdrawals from lending pools and markets that traced wallets (chain, wallet) made to another
    address: exits that the wallets' own outflows don't show.  The wallet is the last word of
    the position; the event names both ends, so the confidence is high."""
    wallet = F.concat(F.lit("0x"), F.right("position", F.lit(40)))
    exits = events.where("role = 'exit' AND kind IN ('lending', 'market')").withColumn("wallet", wallet)
    found = exits.join(wallets.select("chain", "wallet").distinct(), ["chain", "wallet"]).where("recipient <> wallet")
    return found.select("chain", "wallet", "kind", "contract", "tx", "log", "block", "recipient", F.col("amount0").alias("amount"), F.lit("high").alias("confidence"))


LEG = ["time", "tx", "log", "token", "dst"]


def value_matches(inbound: DataFrame, outbound: DataFrame, days: int, percent: int, keep: int = 3) -> DataFrame:
    """Outflows of the node that an inflow reached, after it and in another transaction: of the
    same symbol with an amount within percent, or of another with such a value.

    Same-symbol matches come first, then the smaller difference.  A sole match of the same
    symbol is of medium confidence, everything else low; several are ambiguous.
    inbound and outbound: node, i_/o_ time, tx, log, token, dst or src, symbol, amt, usd.
    """
    pairs = within(inbound, outbound, ["node"], "i_time", "o_time", days).where("days > 0 AND i_tx <> o_tx")
    same = F.col("i_symbol") == F.col("o_symbol")
    delta = F.when(same, parts_per_million(F.col("o_amt") - F.col("i_amt"), F.col("i_amt"))).otherwise(parts_per_million(F.col("o_usd") - F.col("i_usd"), F.col("i_usd")))
    pairs = pairs.withColumn("same", same).withColumn("ppm", delta).where(F.col("ppm") <= percent * 10_000)
    each = ["node", "i_tx", "i_log", "i_token", "i_src", "i_time", "i_usd"]
    pairs = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*each)))
    best = first_by(pairs, each, [F.desc("same"), "ppm", "o_time", "o_tx", "o_log", "o_token", "o_dst", "o_usd"], keep)
    sure = (F.col("n") == 1) & F.col("same")
    return best.select("node", "i_tx", "i_log", "i_token", "i_src", "o_tx", "o_log", "o_token", "o_dst", "same", F.col("ppm").cast("long").alias("ppm"), "place", "n", F.when(sure, "medium").otherwise("low").alias("confidence"), (F.col("n") > 1).alias("ambiguous"))


def split_legs(inbound: DataFrame, outbound: DataFrame, days: int, percent: int, most: int) -> DataFrame:
    """The largest outflows after an inflow, taken until their sum reaches percent below it: a
    split if the sum (``total``) is then within percent of it and two to ``most`` legs make it."""
    pairs = within(inbound, outbound, ["node"], "i_time", "o_time", days).where("days > 0 AND i_tx <> o_tx AND o_usd <= i_usd")
    all_of = Window.partitionBy("node", "i_tx", "i_log", "i_token", "i_src", "i_time", "i_usd")
    running = F.sum("o_usd").over(all_of.orderBy(F.desc("o_usd"), "o_time", "o_tx", "o_log", "o_token", "o_dst").rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.col("i_usd") * (100 - percent), F.col("i_usd") * (100 + percent)
    taken = pairs.withColumn("running", running).where((F.col("running") - F.col("o_usd")) * 100 < low)
    taken = taken.withColumn("legs", F.count(F.lit(1)).over(all_of)).withColumn("total", F.max("running").over(all_of))
    return taken.where((F.col("legs") >= 2) & (F.col("legs") <= most) & (F.col("total") * 100 >= low) & (F.col("total") * 100 <= high))


def split_matches(inbound: DataFrame, outbound: DataFrame, days: int, percent: int, most: int) -> DataFrame:
    """The splits of ``split_legs``, a row for each inflow."""
    found = split_legs(inbound, outbound, days, percent, most).select("node", "i_tx", "i_log", "i_token", "i_src", "i_time", "i_usd", "legs", "total").distinct()
    return found.select("node", "i_tx", "i_log", "i_token", "i_src", "legs", F.col("total").cast("double").alias("usd"))


def bridge_matches(deposits: DataFrame, withdrawals: DataFrame, days: int, percent: int, near_ppm: int = 1000, tasks: int | None = None) -> DataFrame:
    """The withdrawal of the same symbol on another chain that fits a deposit best, by difference and
    delay; medium if it's clean (half of the tolerance) and no other is within near_ppm, else low.

    A symbol's withdrawals of one day and chain are sorted by value: the two next to a deposit on either side
    tell its least difference and whether it has a rival.  Only what may lie at that very difference,
    a millionth of the value wide, is joined then, so the work grows as the rows do and not as
    their pairs.  tasks: over how many the rows are dealt (None: the session's number).
    """
    each, group = ["i_tx", "i_log", "i_token", "i_src", "i_dst"], ["symbol", "at", "o_chain"]
    deal = lambda rows, *by: rows.repartition(tasks, *by) if tasks else rows
    most = percent * 10_000
    held = withdrawals.where("o_usd > 0").withColumn("at", F.to_date("o_time"))
    chains = held.select("o_chain").distinct()  # as many as there are chains
    asked = deposits.where("i_usd > 0").withColumn("days", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("at", F.date_add(F.to_date("i_time"), F.col("days")))
    asked = asked.crossJoin(F.broadcast(chains)).where("i_chain <> o_chain").select(*group, *each, "days", "i_usd", F.col("i_usd").alias("value"), F.lit(1).alias("kind"))
    both = deal(asked.unionByName(held.select(*group, F.col("o_usd").alias("value"), F.lit(0).alias("kind")), allowMissingColumns=True), *group)
    ppm = lambda c: parts_per_million(c - F.col("i_usd"), F.col("i_usd"))
    sides = {"below": ["value", "kind"], "above": [F.desc("value"), F.desc("kind")]}
    for side, order in sides.items():
        past = Window.partitionBy(*group).orderBy(*order)
        before = F.last(F.when(F.col("kind") == 0, F.col("value")), ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, -1))
        both = both.withColumn("before", before).withColumn("two", F.when(F.col("kind") == 0, F.struct("value", "before")))
        both = both.withColumn(side, F.last("two", ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, 0))).drop("before", "two")
    met = both.where("kind = 1").select(*group, *each, "days", "i_usd", *(ppm(F.col(s)[c]).alias(f"{s}_{c}") for s in sides for c in ("value", "before")))
    ppms = ["below_value", "below_before", "above_value", "above_before"]
    met = deal(met.withColumn("own", F.least("below_value", "above_value")).where(F.col("own") <= most), *each)
    met = met.withColumn("ppm", F.min("own").over(Window.partitionBy(*each)))
    close = sum((F.coalesce((F.col(c) <= F.least(F.col("ppm") + near_ppm, F.lit(most))).cast("int"), F.lit(0)) for c in ppms), F.lit(0))
    met = met.withColumn("rivals", F.sum(close).over(Window.partitionBy(*each))).where("own = ppm")

    width = 1.05e-6 / (1 - percent / 100)  # of a band: no narrower than what has one ppm on one side
    band = lambda value, slack: F.floor((F.ln(value) + slack) / width)
    value, part = F.col("i_usd").cast("double"), F.col("ppm") / 1e6
    ends = lambda low, high: F.array(band(value * low, -1e-9), band(value * high, 1e-9))
    under = F.when(F.col("below_value") == F.col("ppm"), ends(1 - part - 1e-6, 1 - part))
    over = F.when(F.col("above_value") == F.col("ppm"), ends(1 + part, 1 + part + 1e-6))
    bands = F.array_distinct(F.concat(F.coalesce(under, F.array().cast("array<long>")), F.coalesce(over, F.array().cast("array<long>"))))
    met = deal(met.select(*group, *each, "days", "i_usd", "ppm", "rivals", F.explode(bands).alias("band")), *group)
    rest = ["o_tx", "o_log", "o_token", "o_dst", "o_src"]
    given = deal(held.select(*group, "o_usd", *rest), *group).groupBy(*group, "o_usd").agg(F.min(F.struct(*rest)).alias("o")).withColumn("band", band(F.col("o_usd").cast("double"), 0.0))
    found = met.join(given, [*group, "band"]).where(ppm(F.col("o_usd")) == F.col("ppm"))
    best = found.groupBy(*each).agg(F.min(F.struct("days", "o")).alias("best"), F.min("ppm").alias("ppm"), F.min("rivals").alias("rivals"))
    clean = (F.col("rivals") == 1) & (F.col("ppm") <= percent * 5_000)
    return best.select(*each, *(F.col(f"best.o.{c}").alias(c) for c in rest[:-1]), F.col("ppm").cast("long").alias("ppm"), F.col("best.days").cast("long").alias("days"), F.when(clean, "medium").otherwise("low").alias("confidence"))


def swap_pairs(legs: DataFrame) -> DataFrame:
    """Same-transaction pairing: what an address gave and the largest thing of another token that it
    or, failing that, another party got.  legs: tx, log, token, src, dst, usd."""
    given = legs.select("tx", F.col("src").alias("swapper"), F.col("token").alias("given"), F.col("usd").alias("given_usd"), F.col("log").alias("given_log"))
    got = legs.select("tx", F.col("dst").alias("receiver"), F.col("token").alias("got"), F.col("usd").alias("got_usd"), F.col("log").alias("got_log"))
    pairs = given.join(got, "tx").where("given <> got AND given_log <> got_log")
    best = F.max_by(F.struct("got", "receiver", "got_usd"), F.struct((F.col("receiver") == F.col("swapper")).alias("own"), "got_usd", -F.col("got"), -F.col("receiver")))
    return pairs.groupBy("tx", "swapper", "given", "given_log", "given_usd").agg(best.alias("best")).select("tx", "swapper", "given", "given_log", F.col("given_usd").cast("double").alias("given_usd"), F.col("best.got").alias("got"), F.col("best.receiver").alias("receiver"), F.col("best.got_usd").cast("double").alias("got_usd"))


def swap_outputs(logs: DataFrame) -> DataFrame:
    """Of each transaction: the token of the largest total among those that no one gave, and its largest
    single transfer.  logs: tx, token, receiver, usd, is_input."""
    totals = logs.groupBy("tx", "token").agg(F.bool_or("is_input").alias("given"), F.sum("usd").alias("total"), F.max_by("receiver", F.struct("usd", -F.col("receiver"))).alias("receiver"), F.max("usd").alias("largest"))
    best = totals.where("NOT given AND total > 0").groupBy("tx").agg(F.max_by(F.struct("token", "receiver", "total", "largest"), F.struct("total", -F.col("token"))).alias("b"))
    return best.select("tx", "b.token", "b.receiver", F.col("b.total").cast("double").alias("total"), F.col("b.largest").cast("double").alias("largest"))


def sweep_attribution(transfers: DataFrame, exchanges: DataFrame, ratio_percent: int) -> DataFrame:
    """Unlabelled addresses that pass what they get to hot wallets: medium if one wallet got
    ratio_percent or more of the inflow, else low.  exchanges: address, name."""
    hot = exchanges.select(F.col("address").alias("dst"), "name")
    swept = transfers.join(exchanges.select(F.col("address").alias("src")), "src", "left_anti").join(hot, "dst").groupBy(F.col("src").alias("address")).agg(F.sum("usd").alias("swept"), F.count_distinct("dst").alias("n_wallets"), F.min("name").alias("name"))
    inflow = transfers.groupBy(F.col("dst").alias("address")).agg(F.sum("usd").alias("inflow"))
    clean = (F.col("n_wallets") == 1) & (F.col("swept") * 100 >= F.col("inflow") * ratio_percent)
    return swept.join(inflow, "address").select("address", "name", "n_wallets", F.col("swept").cast("double").alias("swept"), F.col("inflow").cast("double").alias("inflow"), F.when(clean, "medium").otherwise("low").alias("confidence"))


def continuity(deposits: DataFrame, withdrawals: DataFrame, tiers: list[tuple[int, int]], keep: int) -> DataFrame:
    """Withdrawals of the same exchange after a deposit, by tiers (days, percent), the tightest first;
    keep of each deposit by value."""
    pairs = within(deposits, withdrawals, ["exchange"], "i_time", "o_time", max(d for d, _ in tiers), ("i_usd", "o_usd", max(p for _, p in tiers))).where("days > 0")
    ppm = parts_per_million(F.col("o_usd") - F.col("i_usd"), F.col("i_usd"))
    tier = F.lit(None).cast("int")
    for k, (days, percent) in reversed(list(enumerate(tiers, 1))):
        tier = F.when((F.col("days") <= days) & (ppm <= percent * 10_000), F.lit(k)).otherwise(tier)
    found = pairs.withColumn("tier", tier).where("tier IS NOT NULL")
    each = ["exchange", "i_tx", "i_log", "i_token", "i_src"]
    return first_by(found, each, ["tier", F.desc("o_usd"), "days", "o_tx", "o_log", "o_token", "o_dst"], keep).select(*each, "o_tx", "o_log", "o_token", "o_dst", "tier", "place")


def drainer_legs(incoming: DataFrame, outgoing: DataFrame, days: int, percent: int) -> DataFrame:
    """Contracts that pass on at least percent of what a victim sent, in the same symbol and within days
    either way, unless something comes back to the victim by then."""
    begun = incoming.withColumn("begin", F.date_sub(F.to_date("i_time"), days))
    near = within(begun, outgoing.select("node", "symbol", "o_time", "o_dst", "o_usd"), ["node", "symbol"], "begin", "o_time", 2 * days)
    each = ["node", "symbol", "i_src", "i_tx", "i_log", "i_token", "i_time", "i_usd"]
    legs = near.groupBy(*each).agg(F.bool_or(F.col("o_dst") == F.col("i_src")).alias("returned"), F.count_if((F.col("o_usd") * 100 >= F.col("i_usd") * percent) & (F.col("o_dst") != F.col("i_src"))).alias("n_forwards"))
    return legs.where("NOT returned AND n_forwards > 0").select("node", "symbol", "i_src", "i_tx", "i_log", "i_token", "n_forwards")


def demix_candidates(deposits: DataFrame, withdrawals: DataFrame, days: int, keep: int) -> DataFrame:
    """Later withdrawals from a deposit's pool with an additive score: the same address 100, the
    same relayer 25, the same gas 20, and 5 where its transaction is the next one; no sign: dropped."""
    pairs = within(deposits, withdrawals, ["pool"], "i_time", "o_time", days).where("days > 0")
    each = ["pool", "i_tx", "i_log", "i_token", "i_address"]
    nearest = F.min(F.struct("o_time", "o_tx")).over(Window.partitionBy(*each))
    score = F.when(F.col("i_address") == F.col("o_address"), 100).otherwise(0) + F.when(F.col("i_relayer") == F.col("o_relayer"), 25).otherwise(0) + F.when(F.col("i_gas") == F.col("o_gas"), 20).otherwise(0) + F.when(F.col("o_tx") == nearest["o_tx"], 5).otherwise(0)
    scored = pairs.withColumn("score", score).where("score > 0")
    return first_by(scored, each, [F.desc("score"), "o_time", "o_tx", "o_log", "o_token", "o_address"], keep).select(*each, "o_tx", "o_log", "o_token", "o_address", F.col("score").cast("long").alias("score"), "place")


def latest_two(snapshots: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """Latest and second latest value of each key (null: there is none)."""
    ranked = first_by(snapshots, [key], [F.desc(time), F.desc(tie)], 2)
    pick = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    return ranked.groupBy(key).agg(pick(1, time).alias("latest_at"), pick(1, value).alias("latest"), pick(2, time).alias("prior_at"), pick(2, value).alias("prior"))


def correlation_lookup(observations: DataFrame, addresses: DataFrame, current_case: Column) -> DataFrame:
    """Other cases in which the addresses appear: counts by flag, summed value, first ten appearances.
    observations: address, chain, case_id, sanctioned, mixer, usd, observed_at.  The tenth is found
    with a window, so that no list of all appearances is held."""
    seen = observations.join(addresses, "address", "left_semi").where(F.col("case_id") != current_case)
    flagged = lambda c: F.count_distinct(F.when(F.col(c), F.col("case_id")))
    whole = seen.groupBy("address", "chain").agg(F.count_distinct("case_id").alias("n_cases"), flagged("sanctioned").alias("n_sanctioned"), flagged("mixer").alias("n_mixer"), F.sum("usd").cast("double").alias("usd"))
    each = seen.groupBy("address", "chain", "case_id").agg(F.min("observed_at").alias("first_at"))
    top = first_by(each, ["address", "chain"], ["first_at", "case_id"], 10).groupBy("address", "chain").agg(F.sort_array(F.collect_list(F.struct("place", "case_id"))).alias("c"))
    return whole.join(top, ["address", "chain"]).select("address", "chain", "n_cases", "n_sanctioned", "n_mixer", "usd", F.array_join(F.transform("c", lambda x: x["case_id"].cast("string")), "|").alias("first_cases"))
