"""Ticks and pending transactions over the events and orders tables: each stream query runs what has
landed, with state and checkpoint, and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgertide.operators.graph import shared_root
from ledgertide.plans.domain import load
from ledgertide.plans.registry import query
from ledgertide.streaming import monitor, pending, ticks


def watchlist(spark, sf):
    """A watch for each user: hot, standard or paused, every ninth closed."""
    users = load(spark, sf, "events").select(F.col("user_id").alias("watch_id")).distinct()
    return users.selectExpr("watch_id", "CASE WHEN watch_id % 9 = 0 THEN 'closed' ELSE 'active' END AS status", "CASE watch_id % 4 WHEN 0 THEN 'hot' WHEN 3 THEN 'paused' ELSE 'standard' END AS priority")


@query("r3_watch_tick", """WITH RECURSIVE s AS (
    SELECT user_id AS watch_id, event_id, ts, CAST(CAST(value AS DECIMAL(20,2)) * 100 AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS txs, CASE user_id % 4 WHEN 0 THEN 3600 ELSE 43200 END AS rest FROM events WHERE user_id % 9 <> 0 AND user_id % 4 <> 3),
  taken AS (
    SELECT *, 1 AS n, CAST(NULL AS BIGINT) AS old_cents, CAST(NULL AS BIGINT) AS old_txs, CAST(NULL AS TIMESTAMP) AS old_ts, CAST(NULL AS BIGINT) AS old_id FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY watch_id ORDER BY ts, event_id) = 1)
    UNION ALL
    SELECT * FROM (SELECT s.*, t.n + 1 AS n, t.cents AS old_cents, t.txs AS old_txs, t.ts AS old_ts, t.event_id AS old_id FROM taken t JOIN s ON s.watch_id = t.watch_id AND epoch_ms(s.ts) - epoch_ms(t.ts) > s.rest * 1000 QUALIFY row_number() OVER (PARTITION BY s.watch_id ORDER BY s.ts, s.event_id) = 1)),
  judged AS (SELECT *, cents - old_cents AS delta, txs - old_txs AS more FROM taken)
  SELECT watch_id, event_id, 'snapshot' AS kind, old_cents AS prior_cents, cents AS usd_cents, delta AS delta_cents, more AS tx_delta, coalesce(abs(delta) >= 10000 OR more > 0, false) AS material FROM judged
  UNION ALL SELECT watch_id, old_id, 'silent', old_cents, NULL, NULL, NULL, true FROM judged WHERE epoch_ms(ts) - epoch_ms(old_ts) >= 3 * 86400000""")
def r3(spark, sf):
    """Snapshots as their cooldown lets them be taken, what changed, and silences of three days that ended."""
    seen = monitor.landed(spark, f"{sf}/events.parquet").selectExpr("user_id AS watch_id", "event_id", "ts AS taken_at", "value AS usd_value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS tx_count")
    found = ticks.run_once(ticks.watch_changes(seen, watchlist(spark, sf), silent_seconds=3 * 86_400, late="400 days"), shared_root(spark), "watch")
    return found.select("watch_id", "event_id", "kind", "prior_cents", "usd_cents", "delta_cents", "tx_delta", "material")


@query("r1_trigger_alerts", """WITH a AS (SELECT user_id AS sub_id, CAST(event_id AS VARCHAR) AS tx, event_id AS ord, ts, CASE WHEN event_type IN ('purchase', 'click') THEN 'outflow' ELSE 'inflow' END AS direction, value AS usd, event_id % 11 = 0 AS sanctioned FROM events
    WHERE user_id % 13 <> 0 AND event_id > user_id * 37 % 3000 AND (user_id % 6 <> 0 OR ts < TIMESTAMP '2024-01-20'))
  SELECT sub_id, tx, CAST(ord AS BIGINT) AS ord, CASE sub_id % 5 WHEN 0 THEN 'movement: ' || direction WHEN 1 THEN 'outflow over threshold' WHEN 2 THEN 'balance drop' ELSE 'sanctioned contact: ' || direction END AS reason
  FROM a WHERE sub_id % 5 = 0 OR (sub_id % 5 = 1 AND direction = 'outflow' AND usd >= sub_id % 50) OR (sub_id % 5 = 2 AND direction = 'outflow') OR (sub_id % 5 = 3 AND sanctioned)""")
def r1(spark, sf):
    """All four triggers, and one that doesn't exist, after each subscription's cursor; addresses in different
    case; paused and expired subscriptions."""
    account = lambda c: F.concat(F.lit("0x"), F.substring(F.sha2(F.col(c).cast("string").cast("binary"), 256), 1, 40))
    users = load(spark, sf, "events").select(F.col("user_id").alias("sub_id")).distinct()
    kinds = F.array(*map(F.lit, ("any_movement", "movement_above_usd", "balance_drop", "ofac_contact", "unheard_of")))
    subs = users.select(
        "sub_id", F.concat(F.lit("0x"), F.upper(F.substring(account("sub_id"), 3, 40))).alias("address"), F.element_at(kinds, (F.col("sub_id") % 5 + 1).cast("int")).alias("trigger_type"), (F.col("sub_id") % 50).cast("double").alias("threshold"),
        F.when(F.col("sub_id") % 13 == 0, "paused").otherwise("active").alias("status"), F.when(F.col("sub_id") % 6 == 0, F.expr("TIMESTAMP '2024-01-20 00:00:00'")).alias("expires_at"), (F.col("sub_id") * 37 % 3000).alias("cursor_ord"),
    )
    seen = monitor.landed(spark, f"{sf}/events.parquet")
    direction = F.when(F.col("event_type").isin("purchase", "click"), "outflow").otherwise("inflow")
    activities = seen.select(account("user_id").alias("address"), F.col("event_id").cast("string").alias("tx"), F.col("event_id").alias("ord"), F.col("ts").alias("at"), direction.alias("direction"), F.col("value").alias("usd"), (F.col("event_id") % 11 == 0).alias("sanctioned"))
    return ticks.run_once(ticks.monitor_alerts(activities, subs, late="400 days"), shared_root(spark), "monitor")


PARTY = "'0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 40)"
PENDING_SQL = f"""WITH e AS (SELECT event_id AS id, user_id, {PARTY.format('user_id')} AS user, {PARTY.format('event_id + 1000000')} AS other, event_id % 8 AS turn, user_id % 5 = 0 AS watched FROM events)
  SELECT id, CASE WHEN turn IN (0, 1, 2, 7) THEN user END AS address, CASE WHEN turn IN (0, 1, 7) THEN other WHEN turn = 2 THEN NULL END AS counterparty, 'h' || id AS tx_hash,
    CASE turn WHEN 0 THEN CAST(id * 16 AS VARCHAR) WHEN 1 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' WHEN 7 THEN CAST(id AS VARCHAR) END AS value_wei,
    CASE turn WHEN 0 THEN 'inbound' WHEN 3 THEN 'unknown' ELSE 'outbound' END AS direction
  FROM e WHERE turn = 3 OR (watched AND turn IN (0, 1, 2, 7))"""


def event_frames(spark, sf):
    """id, frame: for each event a notification of one kind or another, an acknowledgement, or broken text."""
    party = lambda c: F.concat(F.lit("0x"), F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 40))
    user, other, i = party(F.col("user_id")), party(F.col("event_id") + 1_000_000), F.col("event_id")
    shown = F.concat(F.lit("0x"), F.upper(F.substring(user, 3, 40)))
    note = lambda result: F.concat(F.lit('{"jsonrpc":"2.0","method":"eth_subscription","params":{"subscription":"0x1","result":'), result, F.lit("}}"))
    full = lambda sender, to, value: note(F.to_json(F.struct(sender.alias("from"), to.alias("to"), F.concat(F.lit("h"), i).alias("hash"), value.alias("value"))))
    kinds = [
        full(other, user, F.concat(F.lit("0x"), F.lower(F.hex(i)), F.lit("0"))), full(user, other, F.lit("0x" + "f" * 64)), full(user, F.lit(None).cast("string"), F.lit(None).cast("string")), note(F.concat(F.lit('"h'), i, F.lit('"'))),
        F.lit('{"id":1,"result":"0xsubscription"}'), F.concat(F.lit('{"params":{"result":'), i), full(other, other, F.lit("0x1")), full(user, other, i.cast("string")),
    ]
    frame = F.element_at(F.array(*kinds), (i % 8 + 1).cast("int"))
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), frame.alias("frame"), shown.alias("shown"), "user_id")


def watched_users(spark, sf):
    return event_frames(spark, sf).where("user_id % 5 = 0").select(F.col("shown").alias("address"))


PENDING_COLUMNS = ["address", "counterparty", "tx_hash", "value_wei", "direction"]


@query("r8_pending_alerts", PENDING_SQL)
def r8(spark, sf):
    """Every shape of notification, against watched addresses in another case."""
    found = pending.pending_alerts(event_frames(spark, sf).select("id", "frame"), watched_users(spark, sf), "ethereum")
    return found.select("id", F.lower("address").alias("address"), *PENDING_COLUMNS[1:])


@query("s35_pending_stream", PENDING_SQL.replace("SELECT id, ", "SELECT ", 1))
def s35(spark, sf):
    """The same frames, landed as files and replayed by the stream source."""
    root = shared_root(spark)
    folder = f"{root if ':' in root else 'file://' + root}/frames-{uuid.uuid4().hex[:12]}"
    event_frames(spark, sf).select("frame").write.text(folder)
    hits = pending.pending_alerts(pending.frames(spark, folder), watched_users(spark, sf), "ethereum")
    return ticks.run_once(hits, root, "pending").select(F.lower("address").alias("address"), *PENDING_COLUMNS[1:])
