"""Operators on small inputs whose results are known, and those that SQL can't express."""

from __future__ import annotations

import datetime
import random
import statistics
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgertide.functions import expressions as X
from ledgertide.operators import aggregates as A
from ledgertide.operators import graph as G
from ledgertide.operators import joins as J
from ledgertide.operators.subsets import MOST_FOR_TRIPLES, input_subsets, subsets
from ledgertide.sources import landing
from ledgertide.streaming import monitor


def got(df):
    return sorted(tuple(r) for r in df.collect())


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_within_has_each_pair_once(spark):
    left = spark.createDataFrame([(1, day(d), d) for d in range(0, 40, 3)], "k int, lt timestamp_ntz, l int")
    right = spark.createDataFrame([(1, day(d), d) for d in range(0, 40)], "k int, rt timestamp_ntz, r int")
    pairs = J.within(left, right, ["k"], "lt", "rt", 5).select("l", "r")
    assert got(pairs) == sorted((a, b) for a in range(0, 40, 3) for b in range(40) if 0 <= b - a <= 5)


def test_bfs_stops_at_closed_nodes(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src int, dst int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert got(G.bfs(edges, seeds, 9)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert got(G.bfs(edges, seeds, 9, spark.createDataFrame([(3,)], "node int"))) == [(1, 0), (2, 1), (3, 2)]


def test_components_of_a_path_and_a_pair(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 101), (5, 5)], "a int, b int")
    assert got(G.components(edges)) == [(k, 0) for k in range(21)] + [(100, 100), (101, 100)]


def test_components_without_edges(spark):
    assert got(G.components(spark.createDataFrame([], "a int, b int"))) == []


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "src int, dst int")
    assert got(G.strong_components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_peel_chain_and_cycle(spark):
    edges = spark.createDataFrame([(1, 2, 90), (1, 50, 10), (2, 3, 80), (2, 51, 10), (3, 4, 70), (3, 52, 10), (8, 9, 60), (8, 53, 5), (9, 8, 60), (9, 54, 5)], "src int, dst int, usd int")
    assert got(G.peel_chains(G.peel_links(edges, 60), 3, 5)) == [(1, 4, 3, "low")]


def test_walks_have_no_cap(spark):
    path = [(k, k + 1) for k in range(14)]
    assert got(G.bfs(spark.createDataFrame(path, "src int, dst int"), spark.createDataFrame([(0,)], "node int"), None)) == [(k, k) for k in range(15)]
    links = [(k, k + 1) for k in range(70)] + [(200, 201), (201, 202), (202, 203), (203, 204), (204, 202), (300, 301), (301, 301), (400, 201)]
    assert got(G.peel_chains(spark.createDataFrame(links, "src int, dst int"), 1, 5)) == [(0, 70, 70, "medium"), (200, 204, 4, "low"), (300, 301, 1, "low"), (400, 204, 4, "low")]


def test_equal_split_is_no_peel(spark):
    edges = spark.createDataFrame([(1, 2, 50), (1, 3, 50)], "src int, dst int, usd int")
    assert got(G.peel_links(edges, 60)) == []


def test_exposure_keeps_the_best_path(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (1, 3, 1000.0), (3, 2, 500.0), (2, 4, 50.0)], "src int, dst int, usd double")
    found = {r.node: (r.hop, round(r.weight, 6)) for r in G.decayed_exposure(edges, spark.createDataFrame([(1,)], "node int"), 0.5, 3, 1.0).collect()}
    assert found == {2: (2, 250.0), 3: (1, 500.0), 4: (3, 125.0)}


@pytest.mark.parametrize("until,since,at,hit", [(None, None, 5, True), (4, None, 5, False), (5, None, 5, True), (None, 6, 5, False)])
def test_label_bounds(spark, until, since, at, hit):
    row = spark.createDataFrame([(day(0), since and day(since), until and day(until), day(at))], "added_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, t timestamp_ntz")
    assert row.select(J.label_in_force({c: F.col(c) for c in ("added_at", "valid_from", "valid_until")}, F.col("t"))).first()[0] is hit


def test_subsets_against_brute_force(spark):
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 11)
        v, low, size, most = [r.randrange(1, 40) for _ in range(n)], r.randrange(1, 120), r.randrange(1, 7), r.choice([1, 3, 10, 1000])
        high = low + r.randrange(8)
        brute = [list(c) for k in range(1, min(size, n) + 1) for c in combinations(range(n), k) if low <= sum(v[i] for i in c) <= high]
        assert subsets(v, low, high, size, most) == (brute[:most], len(brute) > most)
    inputs, target = [3, 5, 8, 13, 2], 13
    brute = [c for n in range(1, 6) for c in combinations(range(5), n) if 13 <= sum(inputs[i] for i in c) <= 14]
    rows = spark.createDataFrame([(1, inputs, target), (2, None, 4), (3, [], 4), (4, [1, 1, 1], None)], "tx long, inputs array<long>, target long")
    assert [(r.subset, r.truncated) for r in input_subsets(rows, 1, 5, 1000).collect()] == [("|".join(map(str, c)), False) for c in brute]
    assert [r.truncated for r in input_subsets(rows, 1, 5, 2).collect()] == [True, True]


def test_many_inputs_are_searched_and_cuts_are_told():
    even = [2 * k for k in range(10**6, 10**6 + 200)]
    assert subsets(even, 6 * 10**6 + 1, 6 * 10**6 + 1, 6, 200) == ([], False)
    many = [10**6 + k for k in range(MOST_FOR_TRIPLES + 44)]
    found, cut = subsets(many, 4 * 10**6 + 6, 4 * 10**6 + 6, 6, 200)
    assert found == [[0, 1, 2, 3]] and cut  # sets of five and six weren't looked for


def test_totals_without_pairs(spark):
    r = random.Random(4)
    left = [(k, r.choice("ab"), day(r.randrange(12)), r.randrange(10), r.choice("xyz")) for k in range(60)]
    right = [(r.choice("abc"), day(r.randrange(14)) + datetime.timedelta(hours=r.randrange(24)), r.randrange(10), r.choice("xyz")) for _ in range(80)]
    mine = spark.createDataFrame(left, "i int, k string, lt timestamp_ntz, lv long, lc string")
    theirs = spark.createDataFrame(right, "k string, rt timestamp_ntz, rv long, rc string")
    for apart in (None, ("lc", "rc")):
        want = []
        for i, k, t, v, c in left:
            hits = [(rt, rv) for rk, rt, rv, rc in right if rk == k and 0 <= (rt.date() - t.date()).days <= 4 and rv <= v and (not apart or rc != c)]
            if hits:
                want.append((i, len(hits), sum(x for _, x in hits), min(x for x, _ in hits)))
        found = J.totals_within(mine, theirs, ["k"], "lt", "rt", 4, "lv", "rv", apart)
        assert got(found.select("i", "n", "total", "first")) == sorted(want)


def test_policy_stops(spark):
    rows = [
        (1, 2, "0xa", 50.0, 1.0), (1, 3, "0x" + "0" * 40, 50.0, 1.0), (1, 4, "perp:unknown", 50.0, 1.0), (1, 5, "0xb", 9.0, 1.0), (1, 6, "0xc", None, 0.0001), (1, 7, "0xd", None, 5.0), (2, 8, "0xe", 50.0, 1.0), (2, 9, "0xf", 50.0, 1.0),
        (7, 10, "0x1", 50.0, 1.0), (10, 11, "0x2", 50.0, 1.0), (8, 12, "0x3", 50.0, 1.0), (2, 13, "0x4", 50.0, 1.0), (13, 14, "0x5", 50.0, 1.0), (13, 15, "0x6", 50.0, 1.0), (13, 16, "0x7", 50.0, 1.0),
    ]
    transfers = spark.createDataFrame([(a, b, x, day(5), u, m) for a, b, x, u, m in rows], "src long, dst long, address string, block_time timestamp_ntz, usd double, amt double")
    labels = spark.createDataFrame([(8, "ex", "exchange", "high", day(0), None, None), (9, "later", "mixer", "high", day(9), None, None)], "address long, name string, category string, confidence string, added_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    found = {r.node: (r.depth, r.followed, r.stopped) for r in G.policy_trace(transfers, nodes(1), labels, nodes(10), 3, service_outflows=2).collect()}
    assert found == {
        1: (0, True, None), 2: (1, False, "service wallet"), 3: (1, False, "burn"), 4: (1, False, "placeholder"), 7: (1, True, None), 10: (2, False, "contract"),
    }
    found = {r.node: (r.depth, r.followed, r.stopped) for r in G.policy_trace(transfers, nodes(1), labels, nodes(10), 3).collect()}
    assert found[8] == (2, False, "service label") and found[9] == (2, True, None) and found[13] == (2, True, None) and found[14] == (3, False, "depth") and 11 not in found and 12 not in found and 5 not in found and 6 not in found


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_clusters_grow_to_the_components_of_all(spark, order):
    batches = [
        [("g1", "a"), ("g1", "b"), ("g2", "c"), ("g2", "d"), ("g9", "alone")],
        [("g3", "e"), ("g3", "f"), ("g4", "f"), ("g4", "h"), ("g5", "a"), ("g5", "a")],
        [("g6", "b"), ("g6", "c"), ("g7", "h"), ("g7", "i")],
    ]
    held = spark.createDataFrame([], "address string, chain string, cluster_id string")
    forwards = []
    for k in order:
        groups = spark.createDataFrame([(f"{k}{g}", a, "eth") for g, a in batches[k]], "group_id string, address string, chain string")
        held, forward = G.grown_clusters(held, groups)
        forwards += [tuple(r) for r in forward.collect()]
    clusters = {}
    for r in held.collect():
        clusters.setdefault(r.cluster_id, set()).add(r.address)
    assert sorted(map(sorted, clusters.values())) == [["a", "b", "c", "d"], ["e", "f", "h", "i"]]
    assert all(old > new for old, new in forwards) and not {old for old, _ in forwards} & set(clusters)


def test_newest_generation_of_each_case(spark, tmp_path):
    def put(case, name, address):
        (tmp_path / case).mkdir(exist_ok=True)
        (tmp_path / case / name).write_text(f'{{"case_id": "{case}", "transfers": [{{"transfer_id": "t", "to_address": "{address}"}}]}}')

    put("c1", "x-BRIEF-20260101T000000-aa.json", "old")
    put("c2", "BRIEF-20250101T000000.json", "only")
    put("c1", "BRIEF-20260301T120000-bb.json", "new one")
    put("c1", "BRIEF-20260301T120000-cc.json", "new two")
    put("c1", "BRIEF-20260228T235959.json", "middle")
    put("c1", "notes.json", "none")
    found = landing.read_newest_cases(spark, str(tmp_path))
    assert got(found.select("case_id", "to_address")) == [("c1", "new one"), ("c1", "new two"), ("c2", "only")]
    stale = landing.generations(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")).where("NOT newest")
    assert sorted(r.path.rpartition("/")[2] for r in stale.collect()) == ["BRIEF-20260228T235959.json", "x-BRIEF-20260101T000000-aa.json"]
    (tmp_path / "none").mkdir()
    assert landing.read_cases(spark, []).collect() == []


def test_sanctions_merge_sets_removal_once(spark):
    old = spark.createDataFrame([("x", "eth", "N", "1", "d", None), ("y", "eth", "N", "2", "d", "before")], landing.SANCTION_SCHEMA)
    new = spark.createDataFrame([("z", "eth", "N", "3", "d", None)], landing.SANCTION_SCHEMA)
    merged = {r.address: r.removed_at_utc for r in landing.merge_sanctions(old, new, F.lit("now")).collect()}
    assert merged == {"x": "now", "y": "before", "z": None}


def test_address_expressions(spark):
    row = spark.createDataFrame([("  0x" + "AB" * 20 + " ", None)], "a string, b string")
    assert row.select(X.canonical_key(F.col("a")), X.canonical_key(F.col("b"))).first()[:] == ("0x" + "ab" * 20, "")
    assert row.select(X.scaled_amount(F.lit("5"), F.lit(3)), X.csv_guard(F.lit("=1+1")), X.significant_digits(F.lit("0.01200"))).first()[:] == ("0.005", "'=1+1", 2)


def write_events(folder, rows):
    table = pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()), "user_id": pa.array([r[1] for r in rows], pa.int64()), "ts": pa.array([r[2] for r in rows], pa.timestamp("us")), "event_type": pa.array([r[3] for r in rows]), "value": pa.array([r[4] for r in rows], pa.float64())})
    pq.write_table(table, folder / f"{rows[0][0]:04d}.parquet")


def test_streams(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    write_events(folder, [(1, 7, day(0), "click", 10.0), (2, 7, day(1), "click", 15.0), (3, 8, day(1), "view", 1.0)])
    write_events(folder, [(4, 7, day(2), "click", 15.5), (5, 8, day(2), "view", 40.0)])
    stream = monitor.landed(spark, str(folder), 1)
    changes = monitor.run_to_files(monitor.snapshot_changes(stream, 5.0), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert got(changes.select("user_id", "event_id", "delta")) == [(7, 2, 5.0), (8, 5, 39.0)]
    counts = monitor.run_to_table(monitor.hourly(stream), "hours", str(tmp_path / "c2"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 5
    alerts = monitor.run_to_table(monitor.first_alerts(monitor.landed(spark, str(folder)), "10 days"), "alerts", str(tmp_path / "c3"))
    assert alerts.count() == 2


def test_cursor_replays_only_what_is_new(spark):
    activities = spark.createDataFrame([("a", "t1", 1), ("a", "t2", 2), ("b", "t3", 3)], "address string, tx string, ord int")
    cursors = spark.createDataFrame([("a", 1), ("b", None)], "address string, cursor_ord int")
    assert [r.tx for r in monitor.after_cursor(activities, cursors).collect()] == ["t2"]
    assert got(monitor.next_cursors(activities, cursors)) == [("a", 2), ("b", 3)]


def test_pending_hits_sessions_and_rescreen(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    write_events(folder, [(1, 7, day(0), "click", 1.0), (2, 8, day(0), "click", 1.0)])
    write_events(folder, [(3, 7, day(1), "click", 1.0), (4, 9, day(1), "click", 1.0)])
    stream = monitor.landed(spark, str(folder), 1)
    watched = spark.createDataFrame([(7,), (9,)], "address long")
    hits = monitor.run_to_files(monitor.pending_hits(stream, watched), str(tmp_path / "hits"), str(tmp_path / "c1"))
    assert got(hits.select("event_id", "address")) == [(1, 7), (3, 7), (4, 9)]
    sessions = monitor.run_to_table(monitor.sessions(stream), "sessions", str(tmp_path / "c2"), "complete")
    assert sorted(r.n for r in sessions.collect()) == [1, 1, 1, 1]
    known, alerts = str(tmp_path / "known"), str(tmp_path / "alerts")
    spark.createDataFrame([(8,)], "address long").write.parquet(known)
    additions = stream.select(F.col("user_id").alias("address"))
    for _ in range(2):
        additions.writeStream.foreachBatch(monitor.rescreen(watched, known, alerts)).option("checkpointLocation", str(tmp_path / f"c{_ + 3}")).trigger(availableNow=True).start().awaitTermination()
    assert got(spark.read.parquet(alerts).select("address")) == [(7,), (9,)]
    assert got(spark.read.parquet(known)) == [(7,), (8,), (9,)]


def test_landing_files_come_back(spark, tmp_path):
    token = F.struct(F.lit("ethereum").alias("chain"), F.lit("0xc").alias("contract"), F.lit("USDC").alias("symbol"), F.lit(6).alias("decimals"))
    rows = spark.createDataFrame([("c1", "0xs", "t1", "0xa"), ("c1", "0xs", "t2", "0xb"), ("c2", "0xs", "t3", "=0xa")], "case_id string, seed_address string, transfer_id string, to_address string").withColumn("token", token)
    landing.write_cases(rows, str(tmp_path / "cases"))
    back = spark.read.json(str(tmp_path / "cases")).select("case_id", F.explode("transfers").alias("t")).select("case_id", "t.transfer_id", "t.token.symbol")
    assert got(back) == [("c1", "t1", "USDC"), ("c1", "t2", "USDC"), ("c2", "t3", "USDC")]
    (tmp_path / "one.json").write_text('{"case_id": "c9", "seed_address": "0xs",\n "transfers": [{"transfer_id": "t", "to_address": "0xb"}]}')
    assert [(r.case_id, r.transfer_id, r.to_address) for r in landing.read_cases(spark, str(tmp_path / "one.json")).collect()] == [("c9", "t", "0xb")]
    for name, entries in {"old": '[{"address": "a", "name": "first"}, {"address": "b", "name": "kept"}]', "new": '[{"address": "a", "name": "second"}]'}.items():
        (tmp_path / f"{name}.json").write_text(entries)
    assert got(landing.read_labels(spark, [str(tmp_path / "old.json"), str(tmp_path / "new.json")]).select("address", "name")) == [("a", "second"), ("b", "kept")]
    (tmp_path / "sdn.csv").write_text("address,chain,sdn_entry_name,sdn_entry_id,listing_date,removed_at_utc\n0xa,eth,N,1,2020,\n")
    assert landing.read_sanctions(spark, str(tmp_path / "sdn.csv")).first()[:3] == ("0xa", "eth", "N")
    (tmp_path / "sdn.xml").write_text("<list><sdnEntry><uid>5</uid><lastName>X</lastName><idList><id><idType>Digital Currency Address - XBT</idType><idNumber>1A</idNumber></id><id><idType>Passport</idType><idNumber>9</idNumber></id></idList></sdnEntry></list>")
    assert got(landing.read_sanctions_xml(spark, str(tmp_path / "sdn.xml"))) == [("1A", "XBT", "X", "5")]
    landing.write_findings(rows.drop("token"), str(tmp_path / "findings"))
    assert spark.read.option("header", True).csv(str(tmp_path / "findings/csv")).where("transfer_id = 't3'").first().to_address == "'=0xa"
    assert spark.read.json(str(tmp_path / "findings/json")).count() == 3
    for _ in range(2):
        landing.append_log(rows.drop("token"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 6


def test_value_bands_lose_no_pair(spark):
    values = [round(1.013**k, 4) for k in range(400)] + [0.0]
    left = spark.createDataFrame([(1, day(0), v) for v in values], "k int, lt timestamp_ntz, l double")
    right = spark.createDataFrame([(1, day(1), v) for v in values], "k int, rt timestamp_ntz, r double")
    near = lambda df: got(df.where("l > 0 AND abs(r - l) <= 0.05 * l").select("l", "r"))
    assert near(J.within(left, right, ["k"], "lt", "rt", 2, ("l", "r", 5))) == near(J.within(left, right, ["k"], "lt", "rt", 2))


def test_checksums():
    from ledgertide.functions import checksums as K

    assert K.sound("bitcoin", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4") and not K.sound("bitcoin", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5")
    assert K.base58_payload("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")[0] == 0 and K.base58_payload("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb") is None
    assert K.bech32_constant("A12UEL5L") == 1 and K.bech32_constant("a1lqfn3a") == K.BECH32M and K.bech32_constant("A12uEL5L") is None


def test_value_frontier_follows_matches_and_splits_at_services(spark):
    """1 pays services 2 and 3 and the plain node 4; 2 passes the amount on, 3 splits it, both hold other outflows."""
    columns = "src int, dst int, tx int, log int, token int, time date, symbol int, amt int, usd int"
    day = lambda d: datetime.date(2020, 1, d)
    flows = [(1, 2, 1, 1, 1, 1, 100), (1, 3, 2, 1, 1, 1, 100), (1, 4, 3, 1, 1, 1, 7), (2, 5, 4, 1, 1, 2, 99), (2, 6, 5, 1, 1, 2, 50), (3, 7, 6, 1, 1, 3, 60), (3, 8, 7, 1, 1, 3, 40), (3, 9, 8, 1, 1, 3, 20), (4, 10, 9, 1, 1, 4, 900), (2, 11, 10, 1, 1, 1, 100)]
    legs = spark.createDataFrame([(a, b, tx, log, token, day(d), 1, v, v) for a, b, tx, log, token, d, v in flows], columns)
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node int")
    found = G.value_frontier(legs, nodes(1), nodes(2, 3), 3, 30, 2, 10, 8)
    assert got(found) == [(1, 0, "seed"), (2, 1, "all"), (3, 1, "all"), (4, 1, "all"), (5, 2, "match"), (7, 2, "split"), (8, 2, "split"), (10, 2, "all")]


def test_next_spend_crosses_months_and_takes_the_same_moment(spark):
    day = lambda m, d: datetime.date(2020, m, d)
    outputs = spark.createDataFrame([("a", day(1, 5)), ("a", day(1, 20)), ("a", day(4, 1)), ("a", day(9, 2)), ("b", day(1, 1))], "account string, at date")
    spends = spark.createDataFrame([("a", day(1, 5), 9), ("a", day(1, 5), 8), ("a", day(1, 10), 1), ("a", day(6, 1), 2), ("a", day(6, 30), 3), ("c", day(1, 1), 4)], "account string, at date, tx int")
    assert {(r.account, r.at.month, r.at.day): r.next for r in J.next_spend(outputs, spends).collect()} == {("a", 1, 5): 8, ("a", 1, 20): 2, ("a", 4, 1): 2, ("a", 9, 2): None, ("b", 1, 1): None}


def test_trimmed_ranks_agree_with_sorting(spark):
    values = {"ties": [1.0] * 500 + [2.0, 3.0], "spread": [float(i * i % 997) for i in range(700)], "few": [4.0, 1.0], "five": [5.0, 1.0, 9.0, 2.0, 2.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("few", None), ("none", None)], "g string, v double")
    for cells in (2, 256):
        found = {r.g: (r.n, r.trimmed_mean, r.trimmed_median) for r in A.trimmed(rows, ["g"], "v", 5, cells=cells).collect()}
        for g, vs in values.items():
            cut = 0 if len(vs) < 5 else max(len(vs) // 10, 1)
            kept = sorted(vs)[cut : len(vs) - cut]
            assert found[g] == (len(vs), round(statistics.fmean(kept), 6), round(statistics.median(kept), 6))
        assert set(found) == set(values)
