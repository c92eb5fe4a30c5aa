"""Queries against their SQL on small tables that are made for what the smallest ones don't hold."""

from __future__ import annotations

import pathlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgertide.functions import abi
from ledgertide.operators.bundles import inner_transfers, user_operations
from ledgertide.operators.graph import label_exposure
from ledgertide.operators import integrity, joins
from ledgertide.operators.joins import bridge_matches
from ledgertide.operators.subsets import few_inputs, subsets
from ledgertide.plans import catalogue, domain, file_queries
from ledgertide.sources import landing
from tests.test_queries import rows_of

LINE = "CAST({0} AS BIGINT) AS l_orderkey, CAST({1} AS BIGINT) AS l_partkey, CAST({2} AS BIGINT) AS l_suppkey, CAST({3} AS INTEGER) AS l_linenumber, CAST({4} AS DOUBLE) AS l_quantity, CAST({5} AS DOUBLE) AS l_extendedprice, CAST(0 AS DOUBLE) AS l_discount, '{6}' AS l_returnflag, TIMESTAMP '{7}' AS l_shipdate"


def tables(folder, orders: list[tuple], lines: list[tuple], suppliers: list[int]):
    """orders: key, customer; lines: order, part, supplier, number, quantity, price, flag, day."""
    con = duckdb.connect()
    made = {
        "orders": [f"SELECT CAST({k} AS BIGINT) AS o_orderkey, CAST({c} AS BIGINT) AS o_custkey, 'P' AS o_orderpriority, TIMESTAMP '1997-01-01' AS o_orderdate" for k, c in orders],
        "lineitem": ["SELECT " + LINE.format(*line) for line in lines],
        "supplier": [f"SELECT CAST({s} AS BIGINT) AS s_suppkey, 'S{s}' AS s_name" for s in suppliers],
    }
    for name, selects in made.items():
        con.execute(f"COPY ({' UNION ALL '.join(selects)}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def same(spark, con, folder, name):
    found, wanted = catalogue.queries()[name](spark, str(folder)), con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    rows = rows_of(names, wanted.fetchall())
    assert rows_of(found.columns, found.collect()) == rows
    return rows


def test_no_account_number_is_a_burn_of_its_own(spark, tmp_path):
    """57005 is dead in hexadecimal: the trace's SQL knows burns by their number only."""
    lines = [(1, 1, 57005, 1, 5, 100, "A", "1995-03-01"), (2, 1, 57015, 1, 5, 100, "A", "1995-03-01")]
    con = tables(tmp_path, [(1, 6), (2, 57005)], lines, [6, 57005, 57015])
    rows = same(spark, con, tmp_path, "g1_policy_trace")
    assert any("57015" in r for r in rows)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_operations_and_numbers_are_read_without_walking_arrays(spark):
    calls = spark.createDataFrame([(1, "0x", "0x")], "tx int, to string, calldata string")
    operations = user_operations(calls)
    assert plan_of(operations).count("lambdafunction") <= 1  # the text of the calldata alone
    assert "aggregate(" not in plan_of(inner_transfers(operations.select("tx", "index", "sender", "call")))


def test_numbered_words(spark):
    values = [0, 1, 10**8, 2**63, 2**64 - 1, 2**64, 10**40, 2**128 + 5, 2**255, 2**256 - 1]
    rows = spark.createDataFrame([(str(v), bytearray(v.to_bytes(32, "big"))) for v in values] + [(None, bytearray(b"x")), (None, None)], "t string, w binary")
    assert all(r.t == r.w for r in abi.numbered(rows, "w").collect())


def test_a_busy_case_takes_several_documents(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id < 4990, 'busy', if(id < 4995, 'calm', null)) AS case_id", "'s' AS seed_address", "CAST(id AS STRING) AS transfer_id", "'eth' AS chain")
    landing.write_cases(rows, f"{tmp_path}/cases", most=100)
    documents = spark.read.json(f"{tmp_path}/cases").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("transfers")).alias("most")).collect()
    assert {r.case_id: r.n for r in documents if r.case_id != "busy"} == {"calm": 1, None: 1}
    assert max(r.most for r in documents) < 200
    back = landing.read_cases(spark, f"{tmp_path}/cases", lines=True)
    assert back.count() == back.select("transfer_id").distinct().count() == 5000


def test_large_cases_are_cut_where_they_lie_and_packed(spark, tmp_path, monkeypatch):
    """Rows of the largest cases (here one without a name) aren't shuffled; a busy one below and calm ones are gathered as before."""
    monkeypatch.setattr(landing, "LARGE_PART", 2)
    rows = spark.range(0, 5000, 1, 3).selectExpr("CASE WHEN id % 5 > 0 THEN NULL WHEN id < 4900 THEN 'busy' ELSE 'calm' END AS case_id", "'s' AS seed_address", "CAST(id AS STRING) AS transfer_id", "named_struct('chain', 'eth') AS token", "CAST(id AS DECIMAL(28,4)) AS usd_value_at_tx", "TIMESTAMP'1997-01-01' + make_dt_interval(CAST(id AS INT)) AS block_time")
    plans, writer = [], type(rows.write)
    monkeypatch.setattr(writer, "json", lambda w, path, whole=writer.json: plans.append(plan_of(w._df)) or whole(w, path))
    for name, part in (("all", rows), ("large", rows.where("case_id IS NULL")), ("none", rows.where("usd_value_at_tx < 0"))):
        landing.write_cases(part, f"{tmp_path}/{name}", most=100)
        assert {p.suffix for p in (tmp_path / name).glob("part-*")} == {".gz"}
        back = landing.read_cases(spark, f"{tmp_path}/{name}", lines=True)
        want, names = part.select("case_id", "transfer_id", F.col("token.chain"), "usd_value_at_tx", "block_time"), ["case_id", "transfer_id", "token.chain", "usd_value_at_tx", "block_time"]
        assert sorted(map(str, back.select(*names).collect())) == sorted(map(str, want.collect()))
    assert "MapInArrow" in plans[0] and "collect_list" in plans[0] and "MapInArrow" in plans[1] and "Aggregate" not in plans[1]
    sizes = spark.read.json(f"{tmp_path}/all").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("transfers")).alias("most")).collect()
    found = {r.case_id: (r.n, r.most) for r in sizes}
    assert 40 <= found[None][0] <= 43 and found[None][1] == 100  # one short document a task at most
    assert found["busy"][0] == 10 and found["busy"][1] < 200 and found["calm"] == (1, 20)


def test_documents_hold_no_more_than_asked():
    batch = lambda keys: pa.RecordBatch.from_pydict({"case_id": pa.array(keys, pa.string()), "seed_address": pa.array(["s"] * len(keys), pa.string()), "t": pa.array([{"id": str(i)} for i in range(len(keys))], pa.struct([("id", pa.string())]))})
    made = [r for b in landing.documents(iter([batch(["a", None] * 7), batch([]), batch(["a"] * 3 + [None])]), 4) for r in b.to_pylist()]
    assert sorted((str(r["case_id"]), len(r["transfers"])) for r in made) == [("None", 4), ("None", 4), ("a", 2), ("a", 4), ("a", 4)]
    assert [t["id"] for r in made if r["case_id"] == "a" for t in r["transfers"]] == ["0", "2", "4", "6", "8", "10", "12", "0", "1", "2"]


def test_exposure_keeps_victims_as_bits(spark):
    """More victims than a word has bits, against plain sets; and none that pays anyone."""
    rng = random.Random(4)
    edges = list({(rng.randrange(150), rng.randrange(150)): rng.randrange(1, 99) for _ in range(500)}.items())
    risky, victims, weights = set(range(0, 150, 13)), list(range(100)), [1.0, 0.5, 0.25, 0.125]
    want = {}
    for v in victims:
        drained, nodes, value = sum(u for (a, _), u in edges if a == v), {v}, 0.0
        hit = False
        for w in weights:
            step = [(b, u) for (a, b), u in edges if a in nodes]
            risk = [u for b, u in step if b in risky]
            value, nodes, hit = value + w * sum(risk), {b for b, _ in step}, hit or bool(risk)
        if hit:
            want[v] = round(value / drained, 6)
    table = lambda xs, t: spark.createDataFrame(xs, t)
    rows = table([(a, b, u) for (a, b), u in edges], "src long, dst long, usd long").selectExpr("src", "dst", "CAST(usd AS DECIMAL(12,2)) AS usd")
    node = lambda xs: table([(x,) for x in xs], "node long")
    found = {r.victim: r.exposure for r in label_exposure(rows, node(victims), node(sorted(risky)), weights).collect()}
    assert found.keys() == want.keys() and all(abs(found[v] - want[v]) < 2e-6 for v in want)
    assert label_exposure(rows, node([999]), node([0]), weights).count() == 0


def test_swaps_take_more_tasks_as_tables_grow(spark, monkeypatch):
    monkeypatch.setattr(domain, "ROWS_A_TASK", 500)
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name in ("j15_swap_pairing", "j16_swap_outputs"):
        assert "RepartitionByExpression" in plan_of(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
        assert same(spark, con, "/root/testdata/sf0.001", name)


def small(folder="/root/testdata/sf0.001", names=("orders", "lineitem", "supplier")):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["a17_direct_risk", "a42_nft_batches", "g7_swap_continuation", "g25_small_sets", "j6_two_sided_exposure", "j32_bridge_self_audit", "s14_utxo_normaliser"])
def test_transactions_take_more_tasks_as_tables_grow(spark, monkeypatch, name):
    monkeypatch.setattr(domain, "ROWS_A_TASK", 500)
    seen = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "repartition", lambda rows, n, *by, whole=frame.repartition: seen.append(n) or whole(rows, n, *by))
    assert same(spark, small(), "/root/testdata/sf0.001", name)
    assert seen and min(seen) == 6000 // 500


def crossings(rng, n, side, other):
    day = lambda: f"1997-01-0{rng.randrange(1, 7)} 00:00:00"
    kept = {(rng.randrange(2), rng.randrange(n), 1, rng.randrange(5), 7 * rng.randrange(3), rng.randrange(9), day(), rng.choice([1000, 2000]) + rng.randrange(400) * rng.choice([0, 1, 100]) / 10_000, rng.choice("ANR")) for _ in range(n)}
    names = f"symbol long, {side}_tx long, {side}_log int, {side}_token long, {side}_dst long, {side}_src long, day string, usd double, {side}_chain string"
    return names, [(*r[:4], *r[4:]) for r in kept]


def test_best_bridge_match_without_all_pairs(spark):
    """Many equal values and equal differences, against all pairs in SQL; with and without tasks of its own."""
    rng, con, made = random.Random(9), duckdb.connect(), {}
    for side in "io":
        names, rows = crossings(rng, 300, side, "")
        frame = spark.createDataFrame(rows, names)
        made[side] = frame.selectExpr(*(c for c in frame.columns if c not in ("day", "usd")), f"CAST(day AS TIMESTAMP_NTZ) AS {side}_time", f"CAST(usd AS DECIMAL(17,4)) AS {side}_usd").distinct()
        columns = ", ".join(made[side].columns)
        con.execute(f"CREATE TABLE {side} AS SELECT * FROM (VALUES {', '.join(str(tuple(str(v) for v in r)) for r in made[side].collect())}) v({columns})")
        types = {"usd": "DECIMAL(17,4)", "time": "TIMESTAMP", "chain": "VARCHAR"}
        con.execute(f"CREATE TABLE {side}2 AS SELECT {', '.join(f'CAST({c} AS {types.get(c.split("_")[-1], "BIGINT")}) AS {c}' for c in made[side].columns)} FROM {side}")
        con.execute(f"DROP TABLE {side}; ALTER TABLE {side}2 RENAME TO {side}")
    sql = catalogue.oracle_sql()["j9_bridge_matching"]
    wanted = con.execute("WITH p AS" + sql.split("p AS", 1)[1])
    names = [d[0] for d in wanted.description]
    wanted = rows_of(names, wanted.fetchall())
    for tasks in (None, 7):
        found = bridge_matches(made["i"], made["o"], 2, 2, tasks=tasks)
        assert rows_of(found.columns, found.collect()) == wanted
    assert len(wanted) > 100


def test_few_inputs_are_searched_together(spark):
    """The same sets in the same order, one transaction at a time or many at once, cut or not."""
    rng = random.Random(3)
    for n in (1, 2, 5, 8):
        inputs = [sorted(rng.randrange(1, 12) for _ in range(n)) for _ in range(40)]
        targets = [rng.randrange(5, 30) for _ in inputs]
        for most in (2, 200):
            found = list(few_inputs(list(range(40)), inputs, targets, 1, 6, most))
            want = []
            for tx, (values, target) in enumerate(zip(inputs, targets, strict=True)):
                sets, cut = subsets(values, target, target + 1, 6, most)
                want += [(tx, "|".join(map(str, s)), len(s), sum(values[i] for i in s) - target, cut) for s in sets]
            assert found == want


def test_one_file_of_customers_takes_every_core(spark):
    found = catalogue.queries()["f17_address_codecs"](spark, "/root/testdata/sf0.001")
    assert "Repartition" in plan_of(found)


def test_sanctions_are_written_in_files_of_bounded_length(spark, monkeypatch):
    made = []
    monkeypatch.setattr(file_queries, "ENTRIES_A_FILE", 40)
    monkeypatch.setattr(file_queries, "folder", lambda session, name, whole=file_queries.folder: made.append(whole(session, name)) or made[-1])
    assert same(spark, small(names=("customer",)), "/root/testdata/sf0.001", "s29_sanctions_xml")
    assert len(list(pathlib.Path(made[0].removeprefix("file://").removeprefix("file:")).glob("part-*"))) >= 3


def test_few_nodes_meet_all_legs_without_a_shuffle(spark):
    plans, frame = [], type(spark.range(0))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(frame, "checkpoint", lambda rows, whole=frame.checkpoint: plans.append(plan_of(rows)) or whole(rows))
        catalogue.queries()["g5_value_frontier"](spark, "/root/testdata/sf0.001").count()
    assert sum("strategy=broadcast" in p for p in plans) >= 3


def test_report_of_assets_is_made_of_what_was_written(spark, tmp_path):
    rows = spark.createDataFrame([("c", "w", "p", "A|B", "x", 1, 2), ("c", "w", "p", "A|B", "x", 3, None), ("d", "v", "p", "Z", None, 5, None)], "case_id string, wallet string, perpetrator string, symbol string, contract string, amt int, usd int")
    read, reader = [], type(spark.read)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(reader, "json", lambda r, path, whole=reader.json: read.append(path) or whole(r, path))
        landing.write_aggregate(rows, f"{tmp_path}/a")
    assert read == [f"{tmp_path}/a/by_asset"]
    text = sorted(r.value for r in spark.read.text(f"{tmp_path}/a/report").collect())
    assert text == ["| A\\|B | x | 2 | 4 | 2 |", "| Z |  | 1 | 5 |  |"]


def test_round_trips_add_pairs_up_where_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(domain, "ROWS_A_TASK", 700)
    found = catalogue.queries()["j34_bridge_round_trip"](spark, "/root/testdata/sf0.001")
    assert plan_of(found).startswith("MapInArrow")  # pairs are not grouped by a shuffle after it
    assert same(spark, small(), "/root/testdata/sf0.001", "j34_bridge_round_trip")


def test_round_trips_write_a_leg_once_however_many_blocks(spark):
    """Blocks are read again by each task that pairs them, not copied for it."""
    out = spark.range(400).selectExpr("if(id % 2 = 0, 'A', 'R') AS chain", "id % 50 AS sender", "DATE'1997-01-01' + CAST(id % 9 AS INT) AS out_time")
    back = spark.range(300).selectExpr("if(id % 3 = 0, 'A', 'N') AS chain", "id % 70 AS recipient", "DATE'1997-01-01' + CAST(id % 11 AS INT) AS in_time")
    found = joins.party_pairs(out, back, 6, 7)
    assert "Generate" not in plan_of(found) and found.rdd.getNumPartitions() == 49
    pairs = out.join(back, "chain").where("datediff(in_time, out_time) BETWEEN 1 AND 6 AND sender <> recipient").groupBy("chain", "sender", "recipient").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))
    assert joins.party_pairs(out.where("sender < 0"), back, 6, 7).count() == 0


@pytest.mark.parametrize("at_once", [3, 40, 10**6])
def test_pair_counts_in_bounded_batches(monkeypatch, at_once):
    """Dense and sparse sums, against plain pairs; a party that is on both sides doesn't meet itself."""
    monkeypatch.setattr(joins, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    for parties, days in ((4, 9), (2000, 60)):
        sides = [[(rng.randrange(parties), rng.randrange(days), rng.randrange(1, 4)) for _ in range(300)] for _ in range(2)]
        want: dict = {}
        for s, d, n in sides[0]:
            for r, e, m in sides[1]:
                if s != r and 1 <= e - d <= 6:
                    want[s, r] = want.get((s, r), 0) + n * m
        found = [row for part in joins.pair_counts(*(np.array(c) for side in sides for c in zip(*side, strict=True)), 6) for row in zip(*(x.tolist() for x in part), strict=True)]
        assert len(found) == len(want) and {(s, r): n for s, r, n in found} == want


def test_tasks_are_bounded_whatever_number_the_session_has(spark, monkeypatch):
    """The session's partitions are merged by their bytes, so a larger number of them is no bound."""
    monkeypatch.setattr(domain, "ROWS_A_TASK", 500)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert domain.tasks_for(spark, 6000) == 12 and domain.tasks_for(spark, 999) is None
        assert "RepartitionByExpression" in plan_of(catalogue.queries()["j16_swap_outputs"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_asks_meet_the_listed_once(spark):
    kind = "case_id int, issuer string, token string, address string, usd double"
    listed, asks = spark.createDataFrame([(1, "a", "T", "x", 100.0)], kind), spark.createDataFrame([(1, "a", "T", "x", 120.0), (1, "a", "T", "y", 120.0), (1, "a", "T", "x", 105.0)], kind)
    found = integrity.freeze_asks(listed, asks)
    assert plan_of(found).count("Join ") == 1
    assert sorted((r.subject, r.detail) for r in found.collect()) == [("a T x", "20.0"), ("a T y", "not listed")]
