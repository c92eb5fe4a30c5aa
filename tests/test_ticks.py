"""Stateful ticks against a plain loop over all rows, also when a run is stopped and goes on, and frames
that are replayed."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgertide.streaming import pending, ticks

START = datetime.datetime(2024, 1, 1)


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*")


OBSERVED = "watch_id long, event_id long, taken_at timestamp, usd_value decimal(20,2), tx_count long"


def plain_watch(rows, priority, silent=None):
    last, out = {}, []
    for w, e, at, usd, count in sorted(rows, key=lambda r: (r[2], r[1])):
        if w not in priority:
            continue
        rest = {"hot": 3600, "standard": 43200}[priority[w]]
        old = last.get(w)
        if old and (at - old[0]).total_seconds() <= rest:
            continue
        delta = None if not old or usd is None or old[1] is None else round((usd - old[1]) * 100)
        more = None if not old or count is None or old[2] is None else count - old[2]
        out.append((w, e, delta, more, (delta is not None and abs(delta) >= 10_000) or (more or 0) > 0))
        last[w] = (at, usd, count)
    return sorted(out)


def batches(seed):
    """Files of observations whose times grow from one to the next, as far as the watermark asks."""
    r, e = random.Random(seed), 0
    for k in range(5):
        rows = []
        for _ in range(60):
            e += 1
            at = START + datetime.timedelta(hours=20 * k, seconds=r.randrange(20 * 3600))
            rows.append((r.randrange(6), e, at, None if r.random() < 0.05 else float(r.randrange(0, 400)), None if r.random() < 0.05 else r.randrange(3)))
        yield rows


def test_watch_tick_is_the_same_in_one_run_or_three(spark, tmp_path):
    from decimal import Decimal

    parts = [[(w, e, at, None if usd is None else Decimal(int(usd)), c) for w, e, at, usd, c in part] for part in batches(1)]
    watch = [(0, "active", "hot"), (1, "active", "standard"), (2, "active", "paused"), (3, "closed", "hot"), (4, "active", "hot")]
    watchlist = spark.createDataFrame(watch, "watch_id long, status string, priority string")
    want = plain_watch([r for p in parts for r in p], {w: p for w, s, p in watch if s == "active" and p != "paused"})
    for name, stops in (("whole", [5]), ("stopped", [1, 3, 5])):
        folder = f"file://{tmp_path}/{name}"
        done = 0
        for stop in stops:
            for k in range(done, stop):
                write(spark, folder, f"part{k}", parts[k], OBSERVED)
            done = stop
            found = ticks.run_ticks(ticks.watch_changes(stream(spark, folder, OBSERVED), watchlist, late="30 hours"), f"file://{tmp_path}/{name}-out", f"file://{tmp_path}/{name}-state")
        rows = found.where("kind = 'snapshot'").select("watch_id", "event_id", "delta_cents", "tx_delta", "material").collect()
        assert sorted(map(tuple, rows)) == want


def test_a_silent_watch_is_told_once(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    watchlist = spark.createDataFrame([(1, "active", "hot"), (2, "active", "hot")], "watch_id long, status string, priority string")
    day = lambda d: START + datetime.timedelta(days=d)
    for k, rows in enumerate([[(1, 1, day(0)), (2, 2, day(0))], [(2, 3, day(5))], [(2, 4, day(12))], [(2, 5, day(13))]]):
        write(spark, folder, f"part{k}", [(w, e, at, None, 1) for w, e, at in rows], OBSERVED)
        found = ticks.run_ticks(ticks.watch_changes(stream(spark, folder, OBSERVED), watchlist, silent_seconds=6 * 86_400, late="1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    # 1 is silent from day 6; 2 had a snapshot on day 5, and then none before day 11
    assert sorted((r.watch_id, r.event_id) for r in found.where("kind = 'silent'").collect()) == [(1, 1), (2, 3)]


ACTIVITY = "address string, tx string, ord long, at timestamp, direction string, usd double, sanctioned boolean"
SUBS = "sub_id long, address string, trigger_type string, threshold double, status string, expires_at timestamp, cursor_ord long"


def test_monitor_tick_replays_nothing(spark, tmp_path):
    at = lambda d: START + datetime.timedelta(days=d)
    a, nan = "0x" + "ab" * 20, float("nan")
    subs = [
        (1, a.upper().replace("X", "x"), "any_movement", None, "active", None, 0), (2, a, "movement_above_usd", 50.0, "active", None, 0), (3, a, "balance_drop", None, "active", None, 0), (4, a, "ofac_contact", None, "active", None, 0), (5, a, "bogus", None, "active", None, 0),
        (6, a, "any_movement", None, "active", None, None), (7, a, "any_movement", None, "paused", None, 0), (8, a, "any_movement", None, "active", at(2), 0), (9, a, "movement_above_usd", nan, "active", None, 2), (10, "other", "any_movement", None, "active", None, 0),
    ]
    subscriptions = spark.createDataFrame(subs, SUBS)
    parts = [
        [(a, "t1", 1, at(0), "outflow", 60.0, False), (a, "t2", 2, at(0), "inflow", 90.0, True)],
        [(a, "t2", 2, at(1), "inflow", 90.0, True), (a, "t3", 3, at(1), "outflow", nan, False), (a, "t4", 4, at(1), "outflow", 40.0, True)],
        [(a, "t4", 6, at(3), "outflow", 40.0, True), (a, "t5", 5, at(3), "outflow", 50.0, None), (a, "t6", 7, at(3), "inflow", None, False)],
    ]
    want = {
        1: {"t1", "t2", "t3", "t4", "t5", "t6"}, 2: {"t1", "t5"}, 3: {"t1", "t3", "t4", "t5"}, 4: {"t2", "t4"}, 6: {"t3", "t4", "t5", "t6"}, 8: {"t1", "t2", "t3", "t4"}, 9: {"t4", "t5"},
    }
    for name, stops in (("whole", [3]), ("stopped", [1, 2, 3])):
        folder, done = f"file://{tmp_path}/{name}", 0
        for stop in stops:
            for k in range(done, stop):
                write(spark, folder, f"part{k}", parts[k], ACTIVITY)
            done = stop
            found = ticks.run_ticks(ticks.monitor_alerts(stream(spark, folder, ACTIVITY), subscriptions), f"file://{tmp_path}/{name}-out", f"file://{tmp_path}/{name}-state")
        rows = [(r.sub_id, r.tx) for r in found.collect()]
        assert len(rows) == len(set(rows))
        assert {k: {t for s, t in rows if s == k} for k in {s for s, _ in rows}} == want


def frame(result):
    return json.dumps({"jsonrpc": "2.0", "method": "eth_subscription", "params": {"subscription": "0x1", "result": result}})


A, B, C = ("0x" + x * 20 for x in ("aa", "bb", "cc"))
FRAMES = [
    (frame({"from": C, "to": A.upper().replace("X", "x"), "hash": "h1", "value": "0x10"}), (A, C, "h1", "16", "inbound")),
    (frame({"from": B, "to": C, "hash": "h2", "value": str(2**255)}), (B, C, "h2", str(2**255), "outbound")),
    (frame({"from": B, "to": A, "hash": "h3", "value": "0x" + "f" * 64}), (A, B, "h3", str(2**256 - 1), "inbound")),
    (frame({"from": B, "hash": "h4", "value": None}), (B, None, "h4", None, "outbound")),
    (frame({"from": C, "to": C, "hash": "h5", "value": "0x1"}), None),
    (frame("0xhash"), (None, None, "0xhash", None, "unknown")),
    (json.dumps({"id": 1, "result": "0xsub"}), None),
    ("not json {", None),
    ("", None),
    (json.dumps({"params": {"result": [1]}}), None),
]


@pytest.mark.parametrize("runs", [1, 2])
def test_frames_are_read_once(spark, tmp_path, runs):
    folder = tmp_path / "frames"
    folder.mkdir()
    watched = spark.createDataFrame([(A,), (B,), (B.upper().replace("X", "x"),), (None,)], "address string")
    cuts = [0, 4, len(FRAMES)] if runs == 2 else [0, len(FRAMES)]
    for k in range(runs):
        (folder / f"{k:04d}.jsonl").write_text("\n".join(f for f, _ in FRAMES[cuts[k] : cuts[k + 1]]) + "\n")
        hits = pending.pending_alerts(pending.frames(spark, f"file://{folder}"), watched, "ethereum")
        found = ticks.run_ticks(hits, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    rows = [(r.address.lower() if r.address else None, r.counterparty, r.tx_hash, r.value_wei, r.direction) for r in found.collect()]
    assert sorted(rows, key=str) == sorted((w for _, w in FRAMES if w), key=str)
    assert found.agg(F.max("settled")).first()[0] is False
