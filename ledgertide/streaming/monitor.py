"""Structured Streaming over landing folders: windows, deduplication, and state by key.

Queries read what has landed (trigger availableNow) and keep their progress under a
checkpoint folder, so that a run that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def landed(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder (or of one file), with its schema; times become
    session-zone timestamps (watermarks need these)."""
    table = spark.read.parquet(folder)
    schema = table.schema
    if table.inputFiles() and table.inputFiles()[0].endswith(folder.rpartition("/")[2]):
        folder = f"{folder[:-1]}[{folder[-1]}]"  # the file source takes one file only by a pattern
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours: count and sum by event_type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,2)")).alias("total"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of each user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_alerts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One alert a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def pending_hits(frames: DataFrame, watched: DataFrame) -> DataFrame:
    """Stream-static join: pending transactions that touch a watched address."""
    return frames.join(watched, frames["user_id"] == watched["address"]).select("event_id", "address", "ts")


def snapshot_changes(events: DataFrame, least: float) -> DataFrame:
    """(user_id, ts, event_id, value) -> the change of each snapshot from the one before it, of ``least`` or
    more.  State: the last value of each key.  Rows of a batch are taken by (ts, event_id)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # a key's rows of one micro-batch; maxFilesPerTrigger bounds them
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        values = rows["value"].to_numpy()
        before = [last, *values[:-1]]
        state.update((float(values[-1]),))
        rows["delta"] = [None if b is None else round(v - b, 2) for v, b in zip(values, before, strict=True)]
        rows = rows[rows["delta"].notna() & (rows["delta"].astype(float).abs() >= least)]
        yield rows[["user_id", "event_id", "delta"]].astype({"delta": "float64"})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, delta double", "last double", "append", GroupStateTimeout.NoTimeout)


def after_cursor(activities: DataFrame, cursors: DataFrame) -> DataFrame:
    """Activities (address, tx, ord) after each subscription's cursor (address, cursor_ord); without a cursor
    nothing is replayed, and the newest becomes the cursor."""
    joined = activities.join(cursors, "address")
    return joined.where(F.col("cursor_ord").isNotNull() & (F.col("ord") > F.col("cursor_ord"))).drop("cursor_ord")


def next_cursors(activities: DataFrame, cursors: DataFrame) -> DataFrame:
    newest = activities.groupBy("address").agg(F.max("ord").alias("newest"))
    return cursors.join(newest, "address", "left").select("address", F.greatest("cursor_ord", "newest").alias("cursor_ord"))


def rescreen(watchlist: DataFrame, known: str, alerts: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: of the sanctioned addresses in a batch those that the last state (a Parquet folder)
    doesn't have are joined to the watchlist; alerts are appended, and the state with them.  A batch that
    runs again finds its own rows known, and adds nothing."""
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("address").distinct().join(spark.read.parquet(known), "address", "left_anti").persist()
        new.join(watchlist, "address").withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(alerts)
        new.write.mode("append").parquet(known)
        new.unpersist()

    return step


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what has landed into an in-memory table (for tests and small results)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs what has landed into Parquet files (exactly once, by the sink's log)."""
    stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(folder)
