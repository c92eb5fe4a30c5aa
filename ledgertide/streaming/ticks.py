"""Ticks with state: the watch tick (snapshots under a cooldown, changes, silence) and the monitor
tick (alerts after a cursor, each transaction once).

What can be decided by row (who is watched, which trigger fires) is an expression or a join with
a static table before the state; the state of a key is a few numbers.  State, timers and
outputs are kept by the query's checkpoint, so a run that is stopped goes on where it was
and gives the same rows.  They need the RocksDB state store; ``run_ticks`` sets it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgertide.functions.expressions import canonical_key

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOT_SECONDS, STANDARD_SECONDS = 3600, 43_200
CHANGE_CENTS = 10_000
SEEN_DAYS = 30

WATCH_ROWS = "watch_id long, event_id long, taken_at timestamp, kind string, prior_cents long, usd_cents long, delta_cents long, tx_delta long, material boolean, reason string"


class WatchTick(StatefulProcessor):
    """State of a watch: its last snapshot, and whether its silence since then was told.  Rows: watch_id, event_id, taken_at, usd_cents, tx_count, cooldown."""

    def __init__(self, change_cents: int, silent_seconds: int):
        self.change, self.silent = change_cents, silent_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, event_id long, usd_cents long, tx_count long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["taken_at", "event_id"])
        last = self.last.get() if self.last.exists() else None
        began, out = last, []
        for r in batch.itertuples():
            at = int(r.taken_at.timestamp() * 1000)
            if last is not None and at - last[0] <= r.cooldown * 1000:
                continue
            if last is not None and at - last[0] >= self.silent and not last[4]:  # its timer hadn't come yet
                out.append(self._silence(key, last))
            usd = None if pd.isna(r.usd_cents) else int(r.usd_cents)
            count = None if pd.isna(r.tx_count) else int(r.tx_count)
            prior, before = (last[2], last[3]) if last is not None else (None, None)
            delta = None if usd is None or prior is None else usd - prior
            more = None if count is None or before is None else count - before
            reasons = []
            if delta is not None and abs(delta) >= self.change:
                reasons.append(f"balance {'+' if delta >= 0 else '-'}${abs(delta) / 100:,.2f}")
            if more is not None and more > 0:
                reasons.append(f"{more} new transactions")
            out.append((key[0], int(r.event_id), r.taken_at, "snapshot", prior, usd, delta, more, bool(reasons), ", ".join(reasons) or None))
            last = (at, int(r.event_id), usd, count, False)
        if last is not None and last != began:
            if began is not None:
                self.handle.deleteTimer(began[0] + self.silent)
            self.last.update(last)
            self.handle.registerTimer(last[0] + self.silent)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WATCH_ROWS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()
        if not last[4] and expiredTimerInfo.getExpiryTimeInMs() == last[0] + self.silent:
            self.last.update((*last[:4], True))
            yield pd.DataFrame([self._silence(key, last)], columns=[c.split()[0] for c in WATCH_ROWS.split(", ")])

    def _silence(self, key: tuple, last: tuple) -> tuple:
        return (key[0], last[1], pd.Timestamp(last[0] + self.silent, unit="ms"), "silent", last[2], None, None, None, True, f"no snapshot for {self.silent // 3_600_000} hours")

    def close(self) -> None:
        pass


def cooldown_seconds(priority: Column, hot: int = HOT_SECONDS, standard: int = STANDARD_SECONDS) -> Column:
    """How long a watch rests after a snapshot; null for priorities that are never taken."""
    return F.when(priority == "hot", hot).when(priority == "standard", standard)


def watch_changes(observations: DataFrame, watchlist: DataFrame, change_cents: int = CHANGE_CENTS, silent_seconds: int = 7 * 86_400, late: str = "1 day", hot: int = HOT_SECONDS, standard: int = STANDARD_SECONDS) -> DataFrame:
    """observations (a stream of watch_id, event_id, taken_at, usd_value, tx_count) and watchlist (watch_id, status,
    priority) -> ``WATCH_ROWS``.

    Active watches that are hot or standard get a snapshot whenever more than their cooldown has
    passed since the last one; others never.  A snapshot is material if its value changed by
    change_cents or more, or its transactions grew; a first one never is.  A watch
    without a snapshot for silent_seconds of event time gives one row of kind ``silent``.
    Rows later than ``late`` are left out.  A watch's rows of a micro-batch are taken in order
    in one task, so the batch's size (files per trigger) bounds them.
    """
    due = watchlist.where("status = 'active'").select("watch_id", cooldown_seconds(F.col("priority"), hot, standard).alias("cooldown")).where("cooldown IS NOT NULL")
    rows = observations.withWatermark("taken_at", late).join(due, "watch_id").select("watch_id", "event_id", "taken_at", (F.col("usd_value").cast("decimal(20,2)") * 100).cast("long").alias("usd_cents"), F.col("tx_count").cast("long").alias("tx_count"), F.col("cooldown").cast("long").alias("cooldown"))
    return rows.groupBy("watch_id").transformWithStateInPandas(WatchTick(change_cents, silent_seconds), WATCH_ROWS, "append", "EventTime")


ALERT_ROWS = "sub_id long, tx string, ord long, reason string"


class MonitorTick(StatefulProcessor):
    """State of a subscription: its cursor, and the transactions that alerted, each until a timer of event
    time ends it.  Rows: sub_id, tx, ord, at, first_cursor, reason (null: the trigger doesn't fire)."""

    def __init__(self, seen_ms: int):
        self.keep = seen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "ord long")
        self.seen = handle.getMapState("seen", "tx string", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # the cursor of the batch's beginning decides, so rows need no order and are taken as they come
        cursor = self.cursor.get()[0] if self.cursor.exists() else None
        newest = cursor
        for batch in rows:
            first = batch["first_cursor"].dropna()
            known = cursor if cursor is not None else (int(first.iloc[0]) if len(first) else None)
            newest = max(x for x in (newest, int(batch["ord"].max()), known) if x is not None)
            if known is None:  # a first poll replays nothing
                continue
            out = []
            for r in batch[(batch["ord"] > known) & batch["reason"].notna()].drop_duplicates("tx").itertuples():
                if not self.seen.containsKey((r.tx,)):
                    at = int(r.at.timestamp() * 1000)
                    self.seen.updateValue((r.tx,), (at,))
                    self.handle.registerTimer(at + self.keep)
                    out.append((key[0], r.tx, int(r.ord), r.reason))
            if out:
                yield pd.DataFrame(out, columns=["sub_id", "tx", "ord", "reason"])
        if newest is not None and newest != cursor:
            self.cursor.update((newest,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() - self.keep
        for tx in [k for k, (at,) in self.seen.iterator() if at <= until]:
            self.seen.removeKey(tx)
        return iter(())

    def close(self) -> None:
        pass


def trigger_reason(trigger: Column, threshold: Column, direction: Column, usd: Column, sanctioned: Column) -> Column:
    """Why a subscription's trigger fires on an activity; null where it doesn't.  A null threshold is 0;
    amounts that aren't finite never pass one; an unknown trigger never fires."""
    least = F.coalesce(F.when(~F.isnan(threshold.cast("double")), threshold.cast("double")), F.lit(0.0))
    amount = usd.cast("double")
    above = (direction == "outflow") & amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != float("inf")) & (amount >= least)
    return (
        F.when(trigger == "any_movement", F.concat(F.lit("movement: "), direction))
        .when((trigger == "movement_above_usd") & above, F.lit("outflow over threshold"))
        .when((trigger == "balance_drop") & (direction == "outflow"), F.lit("balance drop"))
        .when((trigger == "ofac_contact") & F.coalesce(sanctioned, F.lit(False)), F.concat(F.lit("sanctioned contact: "), direction))
    )


def subscribed(activities: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """activities (address, tx, ord, at, direction, usd, sanctioned) with the active, unexpired subscriptions
    (sub_id, address, trigger_type, threshold, status, expires_at, cursor_ord) to their address, in any
    case: sub_id, tx, ord, at, first_cursor, reason."""
    subs = subscriptions.where("status = 'active'").select("sub_id", canonical_key(F.col("address")).alias("key"), "trigger_type", "threshold", "expires_at", F.col("cursor_ord").alias("first_cursor"))
    rows = activities.withColumn("key", canonical_key(F.col("address"))).join(subs, "key").where("expires_at IS NULL OR at < expires_at")
    reason = trigger_reason(F.col("trigger_type"), F.col("threshold"), F.col("direction"), F.col("usd"), F.col("sanctioned"))
    return rows.select(F.col("sub_id").cast("long").alias("sub_id"), F.col("tx").cast("string").alias("tx"), F.col("ord").cast("long").alias("ord"), "at", F.col("first_cursor").cast("long").alias("first_cursor"), reason.alias("reason"))


def monitor_alerts(activities: DataFrame, subscriptions: DataFrame, late: str = "7 days", seen_days: int = SEEN_DAYS) -> DataFrame:
    """A stream of activities -> ``ALERT_ROWS``: what fires after each subscription's cursor.  The cursor
    begins at cursor_ord; without one the first batch only sets it.  It moves past every
    activity, fired or not, and a transaction alerts a subscription once within seen_days of
    event time.  Rows later than ``late`` are left out."""
    rows = subscribed(activities.withWatermark("at", late), subscriptions)
    return rows.groupBy("sub_id").transformWithStateInPandas(MonitorTick(seen_days * 86_400_000), ALERT_ROWS, "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_ticks(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs what has landed into Parquet files, exactly once by the sink's log.  (State is timed by events:
    with processing time a run over what has landed would never end.)"""
    spark = stream.sparkSession
    with rocks(spark):
        stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder)


def run_once(stream: DataFrame, root: str, name: str) -> DataFrame:
    """``run_ticks`` with a new folder and checkpoint under ``root``."""
    at = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    return run_ticks(stream, f"{at}/rows", f"{at}/state")
