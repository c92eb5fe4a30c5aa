"""Windows (W), sorts and top-k (T) and set operations (U) over the mapped tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgertide.functions.expressions import shape_similarity
from ledgertide.operators import joins as J
from ledgertide.operators.aggregates import money
from ledgertide.plans.domain import L, O, R, S, T, high_risk, labels, letters, load, outcomes, snapshots, transfers
from ledgertide.plans.registry import query


@query("w3_share_of_maximum", f"WITH {T}, g AS (SELECT dst, sum(usd) AS usd FROM t GROUP BY dst) SELECT dst, CAST(usd AS DOUBLE) AS usd, round(CAST(usd AS DOUBLE) / CAST((SELECT max(usd) FROM g) AS DOUBLE), 9) AS share FROM g")
def w3(spark, sf):
    per = transfers(spark, sf).groupBy("dst").agg(money(F.sum("usd")).alias("usd"))
    return per.crossJoin(F.broadcast(per.agg(F.max("usd").alias("top")))).select("dst", "usd", F.round(F.col("usd") / F.col("top"), 9).alias("share"))  # one row


def _deltas(spark, sf):
    by = Window.partitionBy("watch_id").orderBy("taken_at", "event_id")
    return snapshots(spark, sf).withColumn("delta", F.col("usd_value") - F.lag("usd_value").over(by)).withColumn("tx_delta", F.col("tx_count") - F.lag("tx_count").over(by))


DELTAS = f"{S}, d AS (SELECT *, usd_value - lag(usd_value) OVER w AS delta, tx_count - lag(tx_count) OVER w AS tx_delta FROM snapshots WINDOW w AS (PARTITION BY watch_id ORDER BY taken_at, event_id))"


@query("w4_snapshot_deltas", f"WITH {DELTAS} SELECT watch_id, event_id, taken_at, CAST(delta AS DOUBLE) AS delta, tx_delta, abs(delta) >= 100 OR tx_delta > 0 AS material FROM d WHERE delta IS NOT NULL")
def w4(spark, sf):
    rows = _deltas(spark, sf).where("delta IS NOT NULL")
    return rows.select("watch_id", "event_id", "taken_at", money(F.col("delta")).alias("delta"), "tx_delta", ((F.abs("delta") >= 100) | (F.col("tx_delta") > 0)).alias("material"))


@query("w5_movement_verdict", f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY taken_at DESC, event_id DESC) AS place FROM snapshots),
  p AS (SELECT watch_id, max(taken_at) FILTER (WHERE place = 1) AS latest_at, max(usd_value) FILTER (WHERE place = 1) AS latest, max(usd_value) FILTER (WHERE place = 2) AS prior FROM r WHERE place <= 2 GROUP BY watch_id)
  SELECT watch_id, CASE WHEN prior IS NULL THEN 'never' WHEN abs(latest - prior) >= 50 THEN 'moved' ELSE 'still' END AS verdict, latest_at < TIMESTAMP '2024-01-30 00:00:00' AS stale FROM p""")
def w5(spark, sf):
    two = J.latest_two(snapshots(spark, sf), "watch_id", "taken_at", "usd_value", "event_id")
    verdict = F.when(F.col("prior").isNull(), "never").when(F.abs(F.col("latest") - F.col("prior")) >= 50, "moved").otherwise("still")
    return two.select("watch_id", verdict.alias("verdict"), (F.col("latest_at") < F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")).alias("stale"))


@query("w6_first_flows", f"""WITH {T}, i AS (SELECT dst AS node, arg_min(src, (block_time, tx_hash, log_index, token, src)) AS first_from, min(block_time) AS first_in FROM t WHERE usd >= 1000 GROUP BY dst),
  o AS (SELECT src AS node, arg_min(dst, (block_time, tx_hash, log_index, token, dst)) AS first_to, min(block_time) AS first_out FROM t WHERE usd >= 1000 GROUP BY src) SELECT * FROM i FULL JOIN o USING (node)""")
def w6(spark, sf):
    t = transfers(spark, sf).where("usd >= 1000")
    first = lambda other: F.min_by(other, F.struct("block_time", "tx_hash", "log_index", "token", other))
    i = t.groupBy(F.col("dst").alias("node")).agg(first("src").alias("first_from"), F.min("block_time").alias("first_in"))
    o = t.groupBy(F.col("src").alias("node")).agg(first("dst").alias("first_to"), F.min("block_time").alias("first_out"))
    return i.join(o, "node", "full")


@query("w7_time_window_pairs", f"""WITH {T}, l AS (SELECT DISTINCT src, dst, block_time FROM t WHERE usd > 10) SELECT least(x.dst, y.dst) AS a, greatest(x.dst, y.dst) AS b, count(*) AS n FROM l x JOIN l y ON x.src = y.src AND x.dst <> y.dst
  AND date_diff('day', x.block_time, y.block_time) BETWEEN 0 AND 30 GROUP BY ALL""")
def w7(spark, sf):
    legs = transfers(spark, sf).where("usd > 10").select("src", "dst", "block_time").distinct()
    pairs = J.within(legs.toDF("src", "x", "x_time"), legs.toDF("src", "y", "y_time"), ["src"], "x_time", "y_time", 30).where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


TRIPLE = "PARTITION BY l_shipdate, l_partkey % 20 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice"


@query("w8_sandwich", f"""WITH k AS (SELECT l_orderkey, l_shipdate, l_suppkey, lag(l_suppkey) OVER w AS before, lead(l_suppkey) OVER w AS after, lag(l_orderkey) OVER w AS tx_before, lead(l_orderkey) OVER w AS tx_after FROM lineitem WINDOW w AS ({TRIPLE}))
  SELECT l_shipdate AS block, l_suppkey AS victim, before AS attacker, count(*) AS n FROM k WHERE before = after AND before <> l_suppkey AND tx_before <> tx_after GROUP BY ALL""")
def w8(spark, sf):
    by = Window.partitionBy("l_shipdate", F.col("l_partkey") % 20).orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    rows = load(spark, sf, "lineitem").select(F.col("l_shipdate").alias("block"), F.col("l_suppkey").alias("victim"), F.lag("l_suppkey").over(by).alias("attacker"), F.lead("l_suppkey").over(by).alias("after"), F.lag("l_orderkey").over(by).alias("tb"), F.lead("l_orderkey").over(by).alias("ta"))
    return rows.where("attacker = after AND attacker <> victim AND tb <> ta").groupBy("block", "victim", "attacker").agg(F.count(F.lit(1)).alias("n"))


@query("w9_dedupe_best", f"""WITH {O} SELECT letter_id, arg_max(outcome_type, (CASE outcome_type WHEN 'full_freeze' THEN 3 WHEN 'returned' THEN 2 ELSE 1 END, observed_at, outcome_type)) AS outcome_type, count(*) AS n FROM outcomes GROUP BY letter_id""")
def w9(spark, sf):
    rank = F.when(F.col("outcome_type") == "full_freeze", 3).when(F.col("outcome_type") == "returned", 2).otherwise(1)
    return outcomes(spark, sf).groupBy("letter_id").agg(F.max_by("outcome_type", F.struct(rank, "observed_at", "outcome_type")).alias("outcome_type"), F.count(F.lit(1)).alias("n"))


@query("w10_keep_specific", f"WITH {O} SELECT * FROM (SELECT letter_id, outcome_type, count(*) AS n, bool_or(outcome_type <> 'no_response') OVER (PARTITION BY letter_id) AS specific FROM outcomes GROUP BY letter_id, outcome_type) WHERE NOT (specific AND outcome_type = 'no_response')")
def w10(spark, sf):
    per = outcomes(spark, sf).groupBy("letter_id", "outcome_type").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("specific", F.bool_or(F.col("outcome_type") != "no_response").over(Window.partitionBy("letter_id"))).where("NOT (specific AND outcome_type = 'no_response')")


@query("w11_display_name", "SELECT lower(c_mktsegment) AS key, arg_min(c_name, c_custkey) AS shown, min(c_custkey) AS first_seen, count(*) AS n FROM customer GROUP BY ALL")
def w11(spark, sf):
    return load(spark, sf, "customer").groupBy(F.lower("c_mktsegment").alias("key")).agg(F.min_by("c_name", "c_custkey").alias("shown"), F.min("c_custkey").alias("first_seen"), F.count(F.lit(1)).alias("n"))


@query("w12_address_poisoning", f"""WITH {T}, o AS (SELECT src AS victim, dst AS known, min(block_time) AS since FROM t GROUP BY ALL), i AS (SELECT dst AS victim, src AS sender, min(block_time) AS seen_at FROM t WHERE usd < 5000 GROUP BY ALL)
  SELECT victim, sender, arg_min(known, (since, known)) AS imitated, count(*) AS n FROM i JOIN o USING (victim) WHERE since < seen_at AND known <> sender AND known % 50 = sender % 50 AND sender NOT IN (SELECT known FROM o x WHERE x.victim = i.victim) GROUP BY ALL""")
def w12(spark, sf):
    """Small inflows from an address that looks like one that the victim had paid.  Addresses (whose ends go by the
    remainder of 50) meet by the ends that a wallet shows, and are then compared."""
    t = transfers(spark, sf)
    ends = lambda c: F.lpad(F.lower(F.hex(F.col(c) % 50)), 4, "0")
    address = lambda c: F.concat(F.lit("0x"), ends(c), F.substring(F.sha2(F.col(c).cast("string").cast("binary"), 256), 1, 32), ends(c))
    shown = lambda c: F.concat(F.substring(c, 3, 4), F.right(F.col(c), F.lit(4)))
    out = t.groupBy(F.col("src").alias("victim"), F.col("dst").alias("known")).agg(F.min("block_time").alias("since"))
    inward = t.where("usd < 5000").groupBy(F.col("dst").alias("victim"), F.col("src").alias("sender")).agg(F.min("block_time").alias("seen_at"))
    inward = inward.join(out.select("victim", F.col("known").alias("sender")), ["victim", "sender"], "left_anti").withColumn("theirs", address("sender")).withColumn("ends", shown("theirs"))
    pairs = inward.join(out.withColumn("mine", address("known")).withColumn("ends", shown("mine")), ["victim", "ends"])
    pairs = pairs.where(F.col("since") < F.col("seen_at")).where(shape_similarity(F.col("theirs"), F.col("mine")).between(0.95, 0.9999999))
    return pairs.groupBy("victim", "sender").agg(F.min_by("known", F.struct("since", "known")).alias("imitated"), F.count(F.lit(1)).alias("n"))


@query("w13_theft_window", f"""WITH {T}, m AS (SELECT src, arg_max(block_time, (usd, -tx_hash, block_time)) AS seen_at FROM t WHERE src % 97 = 5 GROUP BY src)
  SELECT t.src, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd, min(block_time) AS first_time FROM t JOIN m ON t.src = m.src AND abs(date_diff('day', seen_at, block_time)) <= 200 GROUP BY t.src""")
def w13(spark, sf):
    out = transfers(spark, sf).where("src % 97 = 5")
    primary = out.groupBy("src").agg(F.max_by("block_time", F.struct("usd", -F.col("tx_hash"), "block_time")).alias("seen_at"))
    near = out.join(primary, "src").where(F.abs(F.datediff("block_time", "seen_at")) <= 200)
    return near.groupBy("src").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"), F.min("block_time").alias("first_time"))


@query("w14_outside_incident", f"WITH {T} SELECT case_id, count(*) AS n, count(*) FILTER (WHERE block_time < TIMESTAMP '1995-01-01' OR block_time > TIMESTAMP '1997-12-31') AS n_outside FROM t GROUP BY case_id")
def w14(spark, sf):
    outside = F.expr("block_time < TIMESTAMP_NTZ '1995-01-01 00:00:00' OR block_time > TIMESTAMP_NTZ '1997-12-31 00:00:00'")
    return transfers(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("n_outside"))


@query("t1_endpoints_by_value", f"WITH {T} SELECT dst, CAST(coalesce(sum(CASE WHEN token % 10 <> 0 THEN usd END), 0) AS DOUBLE) AS usd FROM t GROUP BY dst ORDER BY usd DESC, dst")
def t1(spark, sf):
    per = transfers(spark, sf).groupBy("dst").agg(money(F.coalesce(F.sum(F.when(F.col("token") % 10 != 0, F.col("usd"))), F.lit(0))).alias("usd"))
    return per.orderBy(F.desc("usd"), "dst")


@query("t2_top_unlabelled", f"WITH {T}, {L} SELECT dst, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS n FROM t WHERE dst NOT IN (SELECT address FROM labels) GROUP BY dst ORDER BY sum(usd) DESC, n DESC, dst LIMIT 20")
def t2(spark, sf):
    per = transfers(spark, sf).join(labels(spark, sf).select(F.col("address").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.sum("usd").alias("total"), F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("total"), F.desc("n"), "dst").limit(20).select("dst", money(F.col("total")).alias("usd"), "n")  # a top-k report


@query("t3_digest_rank", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 30 WHEN 'error' THEN 40 ELSE 10 END * 2 + CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 20 WHEN ts >= TIMESTAMP '2024-01-15' THEN 10 ELSE 0 END + CASE WHEN user_id % 10 = 0 THEN 5 ELSE 0 END AS rank
  FROM events ORDER BY rank DESC, ts DESC, event_id LIMIT 20""")
def t3(spark, sf):
    severity = F.when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "error", 40).otherwise(10)
    recent = F.expr("CASE WHEN ts >= TIMESTAMP_NTZ '2024-01-25 00:00:00' THEN 20 WHEN ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00' THEN 10 ELSE 0 END")
    rank = severity * 2 + recent + F.when(F.col("user_id") % 10 == 0, 5).otherwise(0)
    return load(spark, sf, "events").withColumn("rank", rank).orderBy(F.desc("rank"), F.desc("ts"), "event_id").limit(20).select("event_id", "rank")  # a top-k report


@query("t5_priority_queue", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey LIMIT 50")
def t5(spark, sf):
    order = F.when(F.col("c_mktsegment") == "MACHINERY", 0).when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2)
    return load(spark, sf, "customer").where("c_acctbal > 0").orderBy(order, F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_mktsegment", "c_acctbal")  # one claim


@query("t7_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def t7(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)  # one page


@query("t8_top_per_group", f"WITH {T}, r AS (SELECT DISTINCT src, dst, usd FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY usd DESC, dst) AS place FROM r) SELECT src, dst, CAST(usd AS DOUBLE) AS usd, place FROM k WHERE place <= 3")
def t8(spark, sf):
    legs = transfers(spark, sf).select("src", "dst", "usd").distinct()
    return J.first_by(legs, ["src"], [F.desc("usd"), "dst"], 3).withColumn("usd", money(F.col("usd")))


@query("t10_recent_alerts", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def t10(spark, sf):
    return load(spark, sf, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", "ts")  # one page


@query("u1_sanctions_delta", f"WITH {R} SELECT address FROM high_risk WHERE risk_category <> 'drainer' EXCEPT SELECT address FROM high_risk WHERE severity = 2")
def u1(spark, sf):
    risk = high_risk(spark, sf)
    return risk.where("risk_category <> 'drainer'").select("address").exceptAll(risk.where("severity = 2").select("address")).distinct()


@query("u2_distinct_parties", f"WITH {T}, p AS (SELECT case_id, src AS party FROM t UNION SELECT case_id, dst FROM t) SELECT case_id, count(*) AS n FROM p GROUP BY case_id")
def u2(spark, sf):
    legs = transfers(spark, sf).select("case_id", F.explode(F.array("src", "dst")).alias("party"))
    return legs.groupBy("case_id").agg(F.count_distinct("party").alias("n"))


@query("u3_role_sets", f"""WITH {O}, k AS (SELECT letter_id, list(DISTINCT outcome_type ORDER BY outcome_type) AS roles FROM outcomes GROUP BY letter_id)
  SELECT letter_id, array_to_string(list_sort(list_intersect(roles, ['full_freeze', 'partial_freeze', 'returned'])), ',') AS wins, len(list_filter(roles, lambda x: x NOT IN ('acknowledged', 'no_response'))) = 0 AS only_silent FROM k""")
def u3(spark, sf):
    sets = outcomes(spark, sf).groupBy("letter_id").agg(F.collect_set("outcome_type").alias("roles"))  # of six kinds
    wins, silent = F.array(*(F.lit(x) for x in ("full_freeze", "partial_freeze", "returned"))), F.array(F.lit("acknowledged"), F.lit("no_response"))
    return sets.select("letter_id", F.array_join(F.array_sort(F.array_intersect("roles", wins)), ",").alias("wins"), (F.size(F.array_except("roles", silent)) == 0).alias("only_silent"))


@query("u4_label_union", f"""WITH {L}, {R}, u AS (SELECT address, risk_category AS category, 1 AS rank FROM high_risk UNION ALL SELECT address, category, 2 FROM labels UNION ALL SELECT s_suppkey, 'seed', 3 FROM supplier)
  SELECT address, arg_min(category, rank) AS category, count(*) AS n FROM u GROUP BY address""")
def u4(spark, sf):
    parts = high_risk(spark, sf).selectExpr("address", "risk_category AS category", "1 AS rank").unionByName(labels(spark, sf).selectExpr("address", "category", "2 AS rank")).unionByName(load(spark, sf, "supplier").selectExpr("s_suppkey AS address", "'seed' AS category", "3 AS rank"))
    return parts.groupBy("address").agg(F.min_by("category", "rank").alias("category"), F.count(F.lit(1)).alias("n"))


@query("u5_benchmark_sets", f"""WITH {T}, e AS (SELECT s_suppkey AS a FROM supplier WHERE s_suppkey % 3 = 0), r AS (SELECT DISTINCT dst AS a FROM t WHERE usd > 95000)
  SELECT (SELECT count(*) FROM (SELECT a FROM e INTERSECT SELECT a FROM r)) AS hit, (SELECT count(*) FROM (SELECT a FROM e EXCEPT SELECT a FROM r)) AS missed, (SELECT count(*) FROM (SELECT a FROM r EXCEPT SELECT a FROM e)) AS more""")
def u5(spark, sf):
    expected = load(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("a"), F.lit(1).alias("e"))
    reached = transfers(spark, sf).where("usd > 95000").select(F.col("dst").alias("a")).distinct().withColumn("r", F.lit(1))
    both = expected.join(reached, "a", "full")
    return both.agg(F.count_if(F.expr("e = 1 AND r = 1")).alias("hit"), F.count_if(F.expr("r IS NULL")).alias("missed"), F.count_if(F.expr("e IS NULL")).alias("more"))


@query("u8_kept_and_dropped", f"WITH {T}, {L} SELECT dst IN (SELECT address FROM labels) AS kept, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd FROM t GROUP BY ALL")
def u8(spark, sf):
    known = labels(spark, sf).select(F.col("address").alias("dst"), F.lit(True).alias("known")).distinct()
    split = transfers(spark, sf).join(known, "dst", "left").withColumn("kept", F.col("known").isNotNull())
    return split.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"))


@query("r17_follow_up_stages", f"""WITH {O}, l AS (SELECT letter_id, min(observed_at) AS answered FROM outcomes GROUP BY letter_id)
  SELECT letter_id, CASE WHEN answered IS NOT NULL THEN 'stopped' WHEN date_diff('day', sent_at, TIMESTAMP '1998-08-01') >= 365 THEN 'escalate' WHEN date_diff('day', sent_at, TIMESTAMP '1998-08-01') >= 30 THEN 'second' ELSE 'first' END AS stage FROM letters LEFT JOIN l USING (letter_id)""")
def r17(spark, sf):
    answered = outcomes(spark, sf).groupBy("letter_id").agg(F.min("observed_at").alias("answered"))
    age = F.datediff(F.expr("TIMESTAMP_NTZ '1998-08-01 00:00:00'"), "sent_at")
    stage = F.when(F.col("answered").isNotNull(), "stopped").when(age >= 365, "escalate").when(age >= 30, "second").otherwise("first")
    return letters(spark, sf).join(answered, "letter_id", "left").select("letter_id", stage.alias("stage"))


@query("r11_recovery_alerts", f"""WITH {DELTAS}, a AS (SELECT watch_id, event_id, delta, CASE WHEN abs(delta) >= 50 AND delta < 0 THEN 'critical' WHEN abs(delta) >= 50 AND watch_id % 3 = 0 THEN 'high' END AS severity FROM d)
  SELECT watch_id, event_id, CAST(delta AS DOUBLE) AS delta, severity FROM a WHERE severity IS NOT NULL""")
def r11(spark, sf):
    severity = F.expr("CASE WHEN abs(delta) >= 50 AND delta < 0 THEN 'critical' WHEN abs(delta) >= 50 AND watch_id % 3 = 0 THEN 'high' END")
    return _deltas(spark, sf).withColumn("severity", severity).where("severity IS NOT NULL").select("watch_id", "event_id", money(F.col("delta")).alias("delta"), "severity")


@query("r6_mail_quota", """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n_24h FROM events""")
def r6(spark, sf):
    return spark.sql("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS n_24h FROM {events}", events=load(spark, sf, "events"))


@query("r18_retrace_backfill", f"""WITH {T}, {L}, c AS (SELECT case_id, max(block_time) - INTERVAL 900 DAY AS traced_at FROM t GROUP BY case_id)
  SELECT t.case_id, count(DISTINCT dst) AS n_new FROM t JOIN c USING (case_id) JOIN labels ON dst = address AND category IN ('exchange', 'mixer') WHERE added_at > traced_at - INTERVAL 1500 DAY GROUP BY t.case_id""")
def r18(spark, sf):
    parties = transfers(spark, sf).groupBy("case_id", "dst").agg(F.max("block_time").alias("last"))
    traced = parties.groupBy("case_id").agg((F.max("last") - F.expr("INTERVAL '2400' DAY")).alias("traced_at"))
    known = labels(spark, sf).where("category IN ('exchange', 'mixer')").selectExpr("address AS dst", "added_at")
    return parties.join(known, "dst").join(traced, "case_id").where("added_at > traced_at").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_new"))
