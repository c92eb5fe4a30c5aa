"""Joins (J) over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.functions import expressions as X
from ledgertide.operators import joins as J
from ledgertide.operators.aggregates import money, strongest_outcome
from ledgertide.plans import domain
from ledgertide.plans.domain import I, L, O, R, S, STRENGTH, T, dealt, high_risk, issuers, labels, letters, load, outcomes, snapshots, tasks_for, transfers
from ledgertide.plans.registry import query

NOW = "TIMESTAMP '2000-01-01 00:00:00'"
#: The tier after so many days, as SQL.
def decayed_sql(at: str) -> str:
    place = "CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
    age = f"date_diff('day', added_at, {at})"
    return f"CASE WHEN confidence IS NOT NULL AND {age} >= 0 THEN ['high', 'medium', 'low'][least({place} + {age} // 180, 3)] ELSE confidence END"


@query("j1_label_lookup", f"""WITH {T}, {L} SELECT dst, name, category, {decayed_sql(NOW)} AS confidence, count(*) AS n
  FROM t LEFT JOIN labels ON dst = address GROUP BY ALL""")
def j1(spark, sf):
    now = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    return J.label_lookup(transfers(spark, sf), labels(spark, sf), now).groupBy("dst", "name", "category", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("j2_point_in_time_labels", f"""WITH {T}, {L} SELECT chain, tx_hash, log_index, block_time, src, dst, token, CAST(usd AS DOUBLE) AS usd, name, category, {decayed_sql("block_time")} AS confidence
  FROM t LEFT JOIN labels ON dst = address AND (added_at IS NULL OR added_at <= block_time) AND (valid_from IS NULL OR valid_from <= block_time) AND (valid_until IS NULL OR valid_until >= block_time)""")
def j2(spark, sf):
    return J.point_in_time_labels(transfers(spark, sf), labels(spark, sf)).select("chain", "tx_hash", "log_index", "block_time", "src", "dst", "token", money(F.col("usd")).alias("usd"), "name", "category", "confidence")


PRICES = """daily AS (SELECT l_partkey AS token, CAST(l_shipdate AS DATE) AS day, max(CAST(l_extendedprice AS DECIMAL(12,2))) AS price FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
  fallback AS (SELECT p_partkey AS token, CAST(p_retailprice AS DECIMAL(12,2)) AS fallback_price FROM part WHERE p_size % 2 = 0)"""


def _prices(spark, sf):
    daily = load(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("token"), F.to_date("l_shipdate").alias("day")).agg(F.max(F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"))
    return daily, load(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("token"), F.col("p_retailprice").cast("decimal(12,2)").alias("fallback_price"))


@query("j4_price_at_time", f"""WITH {T}, {PRICES} SELECT CASE WHEN price IS NOT NULL THEN 'daily' WHEN fallback_price IS NOT NULL THEN 'fallback' ELSE 'none' END AS price_source, chain,
  count(*) AS n, CAST(sum(coalesce(price, fallback_price)) AS DOUBLE) AS total FROM t LEFT JOIN daily d ON t.token = d.token AND CAST(block_time AS DATE) = day LEFT JOIN fallback f ON t.token = f.token GROUP BY ALL""")
def j4(spark, sf):
    return J.priced(transfers(spark, sf), *_prices(spark, sf)).groupBy("price_source", "chain").agg(F.count(F.lit(1)).alias("n"), money(F.sum("unit_price")).alias("total"))


@query("j3_enrichment", f"""WITH {T}, {L}, {PRICES} SELECT tx_hash, log_index, src, dst, t.token, category, CAST(coalesce(price, fallback_price) AS DOUBLE) AS unit_price
  FROM t LEFT JOIN labels ON dst = address LEFT JOIN daily d ON t.token = d.token AND CAST(block_time AS DATE) = day LEFT JOIN fallback f ON t.token = f.token
  WHERE usd >= 50000 AND coalesce(price, fallback_price) IS NOT NULL""")
def j3(spark, sf):
    known = labels(spark, sf).selectExpr("address AS dst", "category")
    rows = J.priced(transfers(spark, sf).where("usd >= 50000"), *_prices(spark, sf)).where("unit_price IS NOT NULL")
    return rows.join(known, "dst", "left").select("tx_hash", "log_index", "src", "dst", "token", "category", money(F.col("unit_price")).alias("unit_price"))


@query("j6_two_sided_exposure", f"""WITH {T}, {R}, x AS (SELECT t.src AS address, t.dst AS counterparty, 'out' AS direction, severity, usd FROM t JOIN high_risk r ON t.dst = r.address
  UNION ALL SELECT t.dst, t.src, 'in', severity, usd FROM t JOIN high_risk r ON t.src = r.address)
  SELECT address, counterparty, direction, severity, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS n FROM x GROUP BY ALL""")
def j6(spark, sf):
    rows = J.two_sided_exposure(transfers(spark, sf), high_risk(spark, sf))
    return rows.groupBy("address", "counterparty", "direction", "severity").agg(money(F.sum("usd")).alias("usd"), F.count(F.lit(1)).alias("n"))


def legs_sql(side: str, node: str, where: str) -> str:
    """Distinct legs with prefixed columns, as a SELECT."""
    other = "dst" if node == "src" else "src"
    return f"""SELECT DISTINCT {node} AS node, {other} AS {side}_{other}, tx_hash AS {side}_tx, log_index AS {side}_log, token AS {side}_token, block_time AS {side}_time, amt AS {side}_amt,
  usd AS {side}_usd, token % 5 AS {side}_symbol, chain AS {side}_chain FROM t WHERE {where}"""


def _legs(spark, sf, side, node, where):
    other = "dst" if node == "src" else "src"
    return transfers(spark, sf).where(where).selectExpr(
        f"{node} AS node", f"{other} AS {side}_{other}", f"tx_hash AS {side}_tx", f"log_index AS {side}_log", f"token AS {side}_token", f"block_time AS {side}_time", f"amt AS {side}_amt", f"usd AS {side}_usd",
        f"token % 5 AS {side}_symbol", f"chain AS {side}_chain",
    ).distinct()


PPM = "CAST(floor(abs(CAST(o_{0} - i_{0} AS DOUBLE)) * 1000000 / CAST(i_{0} AS DOUBLE)) AS BIGINT)"


@query("j7_value_matching", f"""WITH {T}, i AS ({legs_sql("i", "dst", "usd > 10")}), o AS ({legs_sql("o", "src", "usd > 10")}),
  p AS (SELECT *, i_symbol = o_symbol AS same, CASE WHEN i_symbol = o_symbol THEN {PPM.format("amt")} ELSE {PPM.format("usd")} END AS ppm
        FROM i JOIN o USING (node) WHERE date_diff('day', i_time, o_time) BETWEEN 1 AND 30 AND i_tx <> o_tx),
  f AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY same DESC, ppm, o_time, o_tx, o_log, o_token, o_dst, o_usd) AS place FROM p WHERE ppm <= 20000 WINDOW w AS (PARTITION BY node, i_tx, i_log, i_token, i_src, i_time, i_usd))
  SELECT node, i_tx, i_log, i_token, i_src, o_tx, o_log, o_token, o_dst, same, ppm, place, n, CASE WHEN n = 1 AND same THEN 'medium' ELSE 'low' END AS confidence, n > 1 AS ambiguous FROM f WHERE place <= 3""")
def j7(spark, sf):
    return J.value_matches(_legs(spark, sf, "i", "dst", "usd > 10"), _legs(spark, sf, "o", "src", "usd > 10"), 30, 2)


@query("j8_split_matching", f"""WITH {T}, i AS ({legs_sql("i", "dst", "usd > 10")}), o AS ({legs_sql("o", "src", "usd > 10")}),
  p AS (SELECT *, sum(o_usd) OVER (PARTITION BY node, i_tx, i_log, i_token, i_src, i_time, i_usd ORDER BY o_usd DESC, o_time, o_tx, o_log, o_token, o_dst ROWS UNBOUNDED PRECEDING) AS running
        FROM i JOIN o USING (node) WHERE date_diff('day', i_time, o_time) BETWEEN 1 AND 60 AND i_tx <> o_tx AND o_usd <= i_usd),
  g AS (SELECT node, i_tx, i_log, i_token, i_src, i_time, i_usd, count(*) AS legs, max(running) AS total FROM p WHERE (running - o_usd) * 100 < i_usd * 90 GROUP BY ALL)
  SELECT node, i_tx, i_log, i_token, i_src, legs, CAST(total AS DOUBLE) AS usd FROM g WHERE legs BETWEEN 2 AND 8 AND total * 100 BETWEEN i_usd * 90 AND i_usd * 110""")
def j8(spark, sf):
    return J.split_matches(_legs(spark, sf, "i", "dst", "usd > 10"), _legs(spark, sf, "o", "src", "usd > 10"), 60, 10, 8)


def _crossing(spark, sf):
    i = transfers(spark, sf).where("usd > 10 AND dst % 7 = 0").selectExpr("token % 5 AS symbol", "tx_hash AS i_tx", "log_index AS i_log", "token AS i_token", "src AS i_src", "dst AS i_dst", "block_time AS i_time", "usd AS i_usd", "chain AS i_chain").distinct()
    o = transfers(spark, sf).where("usd > 10 AND dst % 7 <> 0").selectExpr("token % 5 AS symbol", "tx_hash AS o_tx", "log_index AS o_log", "token AS o_token", "src AS o_src", "dst AS o_dst", "block_time AS o_time", "usd AS o_usd", "chain AS o_chain").distinct()
    return i, o


CROSSING = """i AS (SELECT DISTINCT token % 5 AS symbol, tx_hash AS i_tx, log_index AS i_log, token AS i_token, src AS i_src, dst AS i_dst, block_time AS i_time, usd AS i_usd, chain AS i_chain FROM t WHERE usd > 10 AND dst % 7 = 0),
  o AS (SELECT DISTINCT token % 5 AS symbol, tx_hash AS o_tx, log_index AS o_log, token AS o_token, src AS o_src, dst AS o_dst, block_time AS o_time, usd AS o_usd, chain AS o_chain FROM t WHERE usd > 10 AND dst % 7 <> 0)"""


@query("j9_bridge_matching", f"""WITH {T}, {CROSSING},
  p AS (SELECT *, {PPM.format("usd")} AS ppm, date_diff('day', i_time, o_time) AS days FROM i JOIN o USING (symbol) WHERE date_diff('day', i_time, o_time) BETWEEN 0 AND 2 AND i_chain <> o_chain),
  f AS (SELECT *, min(ppm) OVER (PARTITION BY i_tx, i_log, i_token, i_src, i_dst) AS least FROM p WHERE ppm <= 20000),
  g AS (SELECT *, count(*) FILTER (WHERE ppm <= least + 1000) OVER (PARTITION BY i_tx, i_log, i_token, i_src, i_dst) AS rivals,
        row_number() OVER (PARTITION BY i_tx, i_log, i_token, i_src, i_dst ORDER BY ppm, days, o_tx, o_log, o_token, o_dst, o_src) AS place FROM f)
  SELECT i_tx, i_log, i_token, i_src, i_dst, o_tx, o_log, o_token, o_dst, ppm, days, CASE WHEN rivals = 1 AND ppm <= 10000 THEN 'medium' ELSE 'low' END AS confidence FROM g WHERE place = 1""")
def j9(spark, sf):
    return J.bridge_matches(*_crossing(spark, sf), 2, 2, tasks=tasks_for(spark, load(spark, sf, "lineitem").count()))


@query("j10_lock_mint", f"""WITH {T}, {CROSSING} SELECT i_tx, i_dst, i_src, count(*) AS n, min(o_time) AS first_mint, CAST(sum(o_usd) AS DOUBLE) AS usd
  FROM i JOIN o ON i.i_src = o.o_src AND date_diff('day', i_time, o_time) BETWEEN 0 AND 20 AND i_chain <> o_chain AND o_usd <= i_usd GROUP BY ALL""")
def j10(spark, sf):
    """No pair of a party's legs is made: a leg meets running totals by day and chain."""
    i, o = _crossing(spark, sf)
    found = J.totals_within(i.drop("symbol").withColumn("party", F.col("i_src")), o.drop("symbol").withColumnRenamed("o_src", "party"), ["party"], "i_time", "o_time", 20, "i_usd", "o_usd", ("i_chain", "o_chain"))
    return found.groupBy("i_tx", "i_dst", "i_src").agg(F.sum("n").alias("n"), F.min("first").alias("first_mint"), money(F.sum("total")).alias("usd"))


@query("j11_pool_disbursement", f"""WITH {T}, i AS ({legs_sql("i", "dst", "usd > 10 AND dst % 13 = 0")}), o AS ({legs_sql("o", "src", "src % 13 = 0")})
  SELECT node, i_tx, i_src, i_log, i_token, count(*) AS n, min(o_time) AS first_out FROM i JOIN o USING (node) WHERE date_diff('day', i_time, o_time) BETWEEN 0 AND 30 AND {PPM.format("usd")} <= 50000 GROUP BY ALL""")
def j11(spark, sf):
    pairs = J.within(_legs(spark, sf, "i", "dst", "usd > 10 AND dst % 13 = 0"), _legs(spark, sf, "o", "src", "src % 13 = 0"), ["node"], "i_time", "o_time", 30, ("i_usd", "o_usd", 5.001))
    pairs = pairs.where(J.parts_per_million(F.col("o_usd") - F.col("i_usd"), F.col("i_usd")) <= 50000)
    return pairs.groupBy("node", "i_tx", "i_src", "i_log", "i_token").agg(F.count(F.lit(1)).alias("n"), F.min("o_time").alias("first_out"))


@query("j12_message_pairing", """WITH a AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS message, o_custkey AS sender, o_totalprice AS sent FROM orders),
  b AS (SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS message, l_suppkey AS receiver, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS got FROM lineitem GROUP BY ALL)
  SELECT message, sender, receiver, CAST(got AS DOUBLE) AS got, CAST(got AS DOUBLE) <= sent AS conserved FROM a JOIN b USING (message)""")
def j12(spark, sf):
    key = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256).alias("message")
    sent = load(spark, sf, "orders").select(key("o_orderkey"), F.col("o_custkey").alias("sender"), F.col("o_totalprice").alias("sent"))
    got = load(spark, sf, "lineitem").groupBy(key("l_orderkey"), F.col("l_suppkey").alias("receiver")).agg(money(F.sum(F.col("l_extendedprice").cast("decimal(12,2)"))).alias("got"))
    return sent.join(got, "message").select("message", "sender", "receiver", "got", (F.col("got") <= F.col("sent")).alias("conserved"))


@query("j13_value_conservation", """SELECT l_orderkey, l_linenumber, l_discount <= 0.05 OR l_quantity = 1 AS conserved, count(*) AS n FROM lineitem GROUP BY ALL""")
def j13(spark, sf):
    """What arrives is what was sent less at most a fee of 5 per cent; an unknown amount proves nothing."""
    price = F.col("l_extendedprice").cast("decimal(20,2)")
    arrived = F.when(F.col("l_quantity") != 1, price * (1 - F.col("l_discount").cast("decimal(4,2)")))
    rows = load(spark, sf, "lineitem").withColumn("conserved", X.conserves_value(price, arrived, F.lit(0.05).cast("decimal(4,2)")))
    return rows.groupBy("l_orderkey", "l_linenumber", "conserved").agg(F.count(F.lit(1)).alias("n"))


@query("j14_handoff", f"""WITH {T}, b AS (SELECT s_suppkey AS bridge, s_name AS protocol FROM supplier WHERE s_suppkey % 7 = 0), h AS (SELECT DISTINCT src, dst, protocol, tx_hash FROM t JOIN b ON dst = bridge)
  SELECT h.src, h.dst AS bridge, protocol, h.tx_hash, n_nationkey AS target_chain, n_name AS chain_name FROM h JOIN nation ON n_nationkey = h.tx_hash % 25""")
def j14(spark, sf):
    bridges = load(spark, sf, "supplier").where("s_suppkey % 7 = 0").selectExpr("s_suppkey AS dst", "s_name AS protocol")
    hand = transfers(spark, sf).join(bridges, "dst").select("src", "dst", "protocol", "tx_hash").distinct().withColumn("target_chain", (F.col("tx_hash") % 25).cast("int"))
    return hand.join(load(spark, sf, "nation").selectExpr("n_nationkey AS target_chain", "n_name AS chain_name"), "target_chain").withColumnRenamed("dst", "bridge")


SWAPS = "legs AS (SELECT DISTINCT l_orderkey AS tx, l_linenumber AS log, l_partkey % 50 AS token, o_custkey % 20 AS src, l_suppkey % 20 AS dst, CAST(l_extendedprice AS DECIMAL(12,2)) AS usd FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _swap_legs(spark, sf):
    lines = load(spark, sf, "lineitem")
    n = lines.count()
    lines = dealt(lines, "l_orderkey", n).join(dealt(load(spark, sf, "orders"), "o_orderkey", n), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.selectExpr("l_orderkey AS tx", "l_linenumber AS log", "l_partkey % 50 AS token", "o_custkey % 20 AS src", "l_suppkey % 20 AS dst", "CAST(l_extendedprice AS DECIMAL(12,2)) AS usd").distinct()


@query("j15_swap_pairing", f"""WITH {SWAPS}, p AS (SELECT a.tx, a.src AS swapper, a.token AS given, a.log AS given_log, a.usd AS given_usd, b.token AS got, b.dst AS receiver, b.usd AS got_usd,
  row_number() OVER (PARTITION BY a.tx, a.src, a.token, a.log, a.usd ORDER BY b.dst = a.src DESC, b.usd DESC, b.token, b.dst) AS place FROM legs a JOIN legs b ON a.tx = b.tx AND a.token <> b.token AND a.log <> b.log)
  SELECT tx, swapper, given, given_log, CAST(given_usd AS DOUBLE) AS given_usd, got, receiver, CAST(got_usd AS DOUBLE) AS got_usd FROM p WHERE place = 1""")
def j15(spark, sf):
    return J.swap_pairs(_swap_legs(spark, sf))


@query("j16_swap_outputs", f"""WITH {SWAPS}, g AS (SELECT tx, token, bool_or(log = 1) AS given, sum(usd) AS total, arg_max(dst, (usd, -dst)) AS receiver, max(usd) AS largest FROM legs GROUP BY tx, token),
  r AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY total DESC, token) AS place FROM g WHERE NOT given AND total > 0)
  SELECT tx, token, receiver, CAST(total AS DOUBLE) AS total, CAST(largest AS DOUBLE) AS largest FROM r WHERE place = 1""")
def j16(spark, sf):
    return J.swap_outputs(_swap_legs(spark, sf).withColumnRenamed("dst", "receiver").withColumn("is_input", F.col("log") == 1))


TIERS = [(3, 1), (15, 3), (40, 5)]


@query("j17_exchange_continuity", f"""WITH {T}, i AS (SELECT DISTINCT dst AS exchange, tx_hash AS i_tx, log_index AS i_log, token AS i_token, src AS i_src, block_time AS i_time, usd AS i_usd FROM t WHERE dst % 11 = 0 AND usd > 10),
  o AS (SELECT DISTINCT src AS exchange, tx_hash AS o_tx, log_index AS o_log, token AS o_token, dst AS o_dst, block_time AS o_time, usd AS o_usd FROM t WHERE src % 11 = 0 AND usd > 10),
  p AS (SELECT *, {PPM.format("usd")} AS ppm, date_diff('day', i_time, o_time) AS days FROM i JOIN o USING (exchange) WHERE date_diff('day', i_time, o_time) BETWEEN 1 AND 40),
  q AS (SELECT *, CASE WHEN days <= 3 AND ppm <= 10000 THEN 1 WHEN days <= 15 AND ppm <= 30000 THEN 2 WHEN ppm <= 50000 THEN 3 END AS tier FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY exchange, i_tx, i_log, i_token, i_src ORDER BY tier, o_usd DESC, days, o_tx, o_log, o_token, o_dst) AS place FROM q WHERE tier IS NOT NULL)
  SELECT exchange, i_tx, i_log, i_token, i_src, o_tx, o_log, o_token, o_dst, tier, place FROM r WHERE place <= 5""")
def j17(spark, sf):
    t = transfers(spark, sf)
    i = t.where("dst % 11 = 0 AND usd > 10").selectExpr("dst AS exchange", "tx_hash AS i_tx", "log_index AS i_log", "token AS i_token", "src AS i_src", "block_time AS i_time", "usd AS i_usd").distinct()
    o = t.where("src % 11 = 0 AND usd > 10").selectExpr("src AS exchange", "tx_hash AS o_tx", "log_index AS o_log", "token AS o_token", "dst AS o_dst", "block_time AS o_time", "usd AS o_usd").distinct()
    return J.continuity(i, o, TIERS, 5)


@query("j18_sweep_attribution", f"""WITH {T}, {L}, x AS (SELECT address, name FROM labels WHERE category = 'exchange'),
  s AS (SELECT src AS address, sum(usd) AS swept, count(DISTINCT dst) AS n_wallets, min(name) AS name FROM t JOIN x ON dst = address WHERE src NOT IN (SELECT address FROM x) GROUP BY src),
  i AS (SELECT dst AS address, sum(usd) AS inflow FROM t GROUP BY dst)
  SELECT address, name, n_wallets, CAST(swept AS DOUBLE) AS swept, CAST(inflow AS DOUBLE) AS inflow, CASE WHEN n_wallets = 1 AND swept * 100 >= inflow * 2 THEN 'medium' ELSE 'low' END AS confidence FROM s JOIN i USING (address)""")
def j18(spark, sf):
    return J.sweep_attribution(transfers(spark, sf), labels(spark, sf).where("category = 'exchange'").select("address", "name"), 2)


@query("j19_onward_flows", f"""WITH {T}, {L}, {R} SELECT src, dst, token % 5 AS symbol, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS n FROM t JOIN labels l ON dst = l.address
  WHERE category = 'exchange' AND src IN (SELECT address FROM high_risk) GROUP BY ALL HAVING sum(usd) >= 20000""")
def j19(spark, sf):
    targets = high_risk(spark, sf).select(F.col("address").alias("src"))
    exchanges = labels(spark, sf).where("category = 'exchange'").select(F.col("address").alias("dst"))
    flows = transfers(spark, sf).join(targets, "src", "left_semi").join(exchanges, "dst").groupBy("src", "dst", (F.col("token") % 5).alias("symbol")).agg(F.sum("usd").alias("total"), F.count(F.lit(1)).alias("n"))
    return flows.where("total >= 20000").select("src", "dst", "symbol", money(F.col("total")).alias("usd"), "n")


@query("j20_exchange_deposits", f"""WITH {T}, {L} SELECT name, src, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd, min(block_time) AS first_time FROM t JOIN labels ON dst = address WHERE category = 'exchange' GROUP BY name, src""")
def j20(spark, sf):
    exchanges = labels(spark, sf).where("category = 'exchange'").selectExpr("address AS dst", "name")
    return transfers(spark, sf).join(exchanges, "dst").groupBy("name", "src").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"), F.min("block_time").alias("first_time"))


@query("j21_freeze_asks", f"""WITH {T}, {I}, h AS (SELECT dst AS holder, token, sum(usd) AS usd FROM t GROUP BY dst, token HAVING sum(usd) >= 60000)
  SELECT holder, token, issuer, CASE WHEN issuer IS NULL OR freeze_capability = 'no' THEN 'unmatched' ELSE 'ask' END AS outcome, CAST(least(usd, 100000) AS DOUBLE) AS usd FROM h LEFT JOIN issuers USING (token)""")
def j21(spark, sf):
    held = transfers(spark, sf).groupBy(F.col("dst").alias("holder"), "token").agg(F.sum("usd").alias("usd")).where("usd >= 60000")
    joined = held.join(issuers(spark, sf), "token", "left")
    unmatched = F.col("issuer").isNull() | (F.col("freeze_capability") == "no")
    return joined.select("holder", "token", "issuer", F.when(unmatched, "unmatched").otherwise("ask").alias("outcome"), money(F.least("usd", F.lit(100000).cast("decimal(28,4)"))).alias("usd"))


@query("j22_historical_asks", f"""WITH {T}, {I} SELECT dst, token, issuer, CAST(sum(usd) AS DOUBLE) AS inflow, count(*) AS n FROM t JOIN issuers USING (token) WHERE dst % 97 <> 5 AND freeze_capability <> 'no' GROUP BY ALL HAVING sum(usd) >= 60000""")
def j22(spark, sf):
    flows = transfers(spark, sf).where("dst % 97 <> 5").groupBy("dst", "token").agg(F.sum("usd").alias("total"), F.count(F.lit(1)).alias("n")).where("total >= 60000")
    return flows.join(issuers(spark, sf).where("freeze_capability <> 'no'"), "token").select("dst", "token", "issuer", money(F.col("total")).alias("inflow"), "n")


OBS = """obs AS (SELECT o_custkey AS address, o_orderpriority AS chain, o_orderkey AS case_id, o_orderstatus = 'F' AS sanctioned, o_orderkey % 3 = 0 AS mixer, CAST(o_totalprice AS DECIMAL(12,2)) AS usd, o_orderdate AS observed_at FROM orders)"""


def _observations(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_custkey AS address", "o_orderpriority AS chain", "o_orderkey AS case_id", "o_orderstatus = 'F' AS sanctioned", "o_orderkey % 3 = 0 AS mixer", "CAST(o_totalprice AS DECIMAL(12,2)) AS usd", "o_orderdate AS observed_at")


@query("j23_correlation_lookup", f"""WITH {OBS}, s AS (SELECT * FROM obs WHERE address IN (SELECT s_suppkey FROM supplier) AND case_id <> 1),
  f AS (SELECT address, chain, case_id, min(observed_at) AS first_at FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY address, chain ORDER BY first_at, case_id) AS place FROM f),
  c AS (SELECT address, chain, string_agg(CAST(case_id AS VARCHAR), '|' ORDER BY place) AS first_cases FROM k WHERE place <= 10 GROUP BY ALL)
  SELECT address, chain, count(DISTINCT case_id) AS n_cases, count(DISTINCT CASE WHEN sanctioned THEN case_id END) AS n_sanctioned, count(DISTINCT CASE WHEN mixer THEN case_id END) AS n_mixer,
  CAST(sum(usd) AS DOUBLE) AS usd, any_value(first_cases) AS first_cases FROM s JOIN c USING (address, chain) GROUP BY ALL""")
def j23(spark, sf):
    return J.correlation_lookup(_observations(spark, sf), load(spark, sf, "supplier").select(F.col("s_suppkey").alias("address")), F.lit(1))


@query("j24_prior_overlap", f"""WITH {OBS}, q AS (SELECT s_suppkey AS address, '1-URGENT' AS chain FROM supplier UNION ALL SELECT s_suppkey, '5-LOW' FROM supplier)
  SELECT DISTINCT case_id, address, chain FROM obs JOIN q USING (address, chain) WHERE sanctioned ORDER BY case_id, address, chain LIMIT 500""")
def j24(spark, sf):
    pairs = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("address"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("chain"))
    found = _observations(spark, sf).where("sanctioned").join(pairs, ["address", "chain"], "left_semi").select("case_id", "address", "chain").distinct()
    return found.orderBy("case_id", "address", "chain").limit(500)  # the report's own limit


@query("j25_latest_two_snapshots", f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY taken_at DESC, event_id DESC) AS place FROM snapshots)
  SELECT watch_id, max(taken_at) FILTER (WHERE place = 1) AS latest_at, CAST(max(usd_value) FILTER (WHERE place = 1) AS DOUBLE) AS latest, max(taken_at) FILTER (WHERE place = 2) AS prior_at, CAST(max(usd_value) FILTER (WHERE place = 2) AS DOUBLE) AS prior
  FROM r WHERE place <= 2 GROUP BY watch_id""")
def j25(spark, sf):
    two = J.latest_two(snapshots(spark, sf), "watch_id", "taken_at", "usd_value", "event_id")
    return two.withColumn("latest", money(F.col("latest"))).withColumn("prior", money(F.col("prior")))


@query("j26_latest_outcome", f"""WITH {O} SELECT letter_id, issuer, arg_max(outcome_type, (observed_at, seq, outcome_type)) AS outcome_type, max(observed_at) AS observed_at, count(seq) AS n FROM letters LEFT JOIN outcomes USING (letter_id) GROUP BY letter_id, issuer""")
def j26(spark, sf):
    last = outcomes(spark, sf).groupBy("letter_id").agg(F.max_by("outcome_type", F.struct("observed_at", "seq", "outcome_type")).alias("outcome_type"), F.max("observed_at").alias("observed_at"), F.count("seq").alias("n"))
    return letters(spark, sf).select("letter_id", "issuer").join(last, "letter_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("j27_follow_up_candidates", f"""WITH {O} SELECT letter_id, issuer, sent_at FROM letters WHERE letter_id NOT IN (SELECT letter_id FROM outcomes) AND sent_at < TIMESTAMP '1998-07-01' AND tier <> 'F' ORDER BY sent_at, letter_id LIMIT 200""")
def j27(spark, sf):
    old = letters(spark, sf).where("sent_at < TIMESTAMP_NTZ '1998-07-01 00:00:00' AND tier <> 'F'").select("letter_id", "issuer", "sent_at")
    return old.join(outcomes(spark, sf).select("letter_id"), "letter_id", "left_anti").orderBy("sent_at", "letter_id").limit(200)  # the report's own limit


@query("j28_without_outcome", f"WITH {O} SELECT issuer, count(*) AS n, CAST(sum(requested_usd) AS DOUBLE) AS usd FROM letters l WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.letter_id = l.letter_id) GROUP BY issuer")
def j28(spark, sf):
    silent = letters(spark, sf).join(outcomes(spark, sf).select("letter_id"), "letter_id", "left_anti")
    return silent.groupBy("issuer").agg(F.count(F.lit(1)).alias("n"), money(F.sum("requested_usd")).alias("usd"))


@query("j29_letters_and_outcomes", f"WITH {O} SELECT issuer, coalesce(outcome_type, 'silence') AS outcome, count(*) AS n FROM letters LEFT JOIN outcomes USING (letter_id) GROUP BY ALL")
def j29(spark, sf):
    return letters(spark, sf).join(outcomes(spark, sf), "letter_id", "left").groupBy("issuer", F.coalesce("outcome_type", F.lit("silence")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("j30_confirmed_wins", f"""WITH {O} SELECT issuer, tier, count(*) AS n, CAST(sum(coalesce(returned_usd, frozen_usd)) AS DOUBLE) AS usd FROM letters JOIN outcomes USING (letter_id) WHERE outcome_type IN ('full_freeze', 'partial_freeze', 'returned') GROUP BY issuer, tier""")
def j30(spark, sf):
    wins = outcomes(spark, sf).where("outcome_type IN ('full_freeze', 'partial_freeze', 'returned')")
    return wins.join(letters(spark, sf), "letter_id").groupBy("issuer", "tier").agg(F.count(F.lit(1)).alias("n"), money(F.sum(F.coalesce("returned_usd", "frozen_usd"))).alias("usd"))


@query("j31_sanctions_on_watchlist", f"WITH {R} SELECT address, c_name AS watched, severity FROM high_risk JOIN customer ON c_custkey = address WHERE risk_category = 'ofac_sanctioned' AND address % 34 <> 0")
def j31(spark, sf):
    added = high_risk(spark, sf).where("risk_category = 'ofac_sanctioned' AND address % 34 <> 0")
    watched = load(spark, sf, "customer").selectExpr("c_custkey AS address", "c_name AS watched")
    return added.join(watched, "address").select("address", "watched", "severity")


@query("j32_bridge_self_audit", f"""WITH {T}, {CROSSING}, p AS (SELECT i_tx, i_log, i_token, i_src, i_dst, i_usd, o_usd, i_time, o_time FROM i JOIN o ON i_tx = o_tx)
  SELECT i_tx, i_src, i_dst, count(*) AS n, count(*) FILTER (WHERE o_time < i_time) AS n_before, count(*) FILTER (WHERE o_usd > i_usd) AS n_larger FROM p GROUP BY i_tx, i_src, i_dst""")
def j32(spark, sf):
    i, o = _crossing(spark, sf)
    pairs = i.join(o, F.col("i_tx") == F.col("o_tx"))
    return pairs.groupBy("i_tx", "i_src", "i_dst").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_time") < F.col("i_time")).alias("n_before"), F.count_if(F.col("o_usd") > F.col("i_usd")).alias("n_larger"))


@query("j33_drainer", f"""WITH {T}, i AS ({legs_sql("i", "dst", "usd > 10")}), o AS ({legs_sql("o", "src", "usd > 10")}),
  p AS (SELECT i.*, o_dst, o_usd FROM i JOIN o ON i.node = o.node AND i_symbol = o_symbol AND abs(date_diff('day', i_time, o_time)) <= 20),
  g AS (SELECT node, i_symbol AS symbol, i_src, i_tx, i_log, i_token, i_time, i_usd, bool_or(o_dst = i_src) AS returned, count(*) FILTER (WHERE o_usd * 100 >= i_usd * 80 AND o_dst <> i_src) AS n_forwards FROM p GROUP BY ALL)
  SELECT node, symbol, i_src, i_tx, i_log, i_token, n_forwards FROM g WHERE NOT returned AND n_forwards > 0""")
def j33(spark, sf):
    i = _legs(spark, sf, "i", "dst", "usd > 10").withColumnRenamed("i_symbol", "symbol")
    o = _legs(spark, sf, "o", "src", "usd > 10").withColumnRenamed("o_symbol", "symbol")
    return J.drainer_legs(i, o, 20, 80)


@query("j34_bridge_round_trip", f"""WITH {T}, a AS (SELECT DISTINCT chain, src AS sender, dst AS bridge, block_time AS out_time, tx_hash AS out_tx FROM t WHERE dst % 7 = 0 AND usd > 10),
  b AS (SELECT DISTINCT chain, src AS bridge_in, dst AS recipient, block_time AS in_time, tx_hash AS in_tx FROM t WHERE src % 7 = 0 AND usd > 10)
  SELECT chain, sender, recipient, count(*) AS n FROM a JOIN b USING (chain) WHERE date_diff('day', out_time, in_time) BETWEEN 1 AND 6 AND sender <> recipient GROUP BY ALL""")
def j34(spark, sf):
    """Blocks of senders meet blocks of recipients; no pair is shuffled."""
    t = transfers(spark, sf).where("usd > 10")
    out = t.where("dst % 7 = 0").select("chain", F.col("src").alias("sender"), F.col("dst").alias("bridge"), F.col("block_time").alias("out_time"), F.col("tx_hash").alias("out_tx")).distinct()
    back = t.where("src % 7 = 0").select("chain", F.col("src").alias("bridge_in"), F.col("dst").alias("recipient"), F.col("block_time").alias("in_time"), F.col("tx_hash").alias("in_tx")).distinct()
    return J.party_pairs(out, back, 6, 1 + load(spark, sf, "lineitem").count() // (3 * domain.ROWS_A_TASK))


@query("j35_demixing", f"""WITH {T}, i AS (SELECT DISTINCT dst AS pool, tx_hash AS i_tx, log_index AS i_log, token AS i_token, src AS i_address, block_time AS i_time, token % 10 AS i_relayer, CAST(amt AS BIGINT) AS i_gas FROM t WHERE dst % 13 = 0 AND usd > 10),
  o AS (SELECT DISTINCT src AS pool, tx_hash AS o_tx, log_index AS o_log, token AS o_token, dst AS o_address, block_time AS o_time, token % 10 AS o_relayer, CAST(amt AS BIGINT) AS o_gas FROM t WHERE src % 13 = 0),
  p AS (SELECT *, first_value(o_tx) OVER (PARTITION BY pool, i_tx, i_log, i_token, i_address ORDER BY o_time, o_tx) AS nearest FROM i JOIN o USING (pool) WHERE date_diff('day', i_time, o_time) BETWEEN 1 AND 60),
  s AS (SELECT *, CASE WHEN i_address = o_address THEN 100 ELSE 0 END + CASE WHEN i_relayer = o_relayer THEN 25 ELSE 0 END + CASE WHEN i_gas = o_gas THEN 20 ELSE 0 END + CASE WHEN o_tx = nearest THEN 5 ELSE 0 END AS score FROM p),
  r AS (SELECT *, row_number() OVER (PARTITION BY pool, i_tx, i_log, i_token, i_address ORDER BY score DESC, o_time, o_tx, o_log, o_token, o_address) AS place FROM s WHERE score > 0)
  SELECT pool, i_tx, i_log, i_token, i_address, o_tx, o_log, o_token, o_address, CAST(score AS BIGINT) AS score, place FROM r WHERE place <= 5""")
def j35(spark, sf):
    t = transfers(spark, sf)
    i = t.where("dst % 13 = 0 AND usd > 10").selectExpr("dst AS pool", "tx_hash AS i_tx", "log_index AS i_log", "token AS i_token", "src AS i_address", "block_time AS i_time", "token % 10 AS i_relayer", "CAST(amt AS BIGINT) AS i_gas").distinct()
    o = t.where("src % 13 = 0").selectExpr("src AS pool", "tx_hash AS o_tx", "log_index AS o_log", "token AS o_token", "dst AS o_address", "block_time AS o_time", "token % 10 AS o_relayer", "CAST(amt AS BIGINT) AS o_gas").distinct()
    return J.demix_candidates(i, o, 60, 5)


@query("w1_strongest_outcome", f"""WITH {O}, r AS (SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY CASE outcome_type WHEN 'full_freeze' THEN 1 WHEN 'returned' THEN 2 WHEN 'partial_freeze' THEN 3 WHEN 'acknowledged' THEN 4 WHEN 'declined' THEN 5 ELSE 6 END, observed_at DESC, seq) AS place FROM outcomes)
  SELECT letter_id, outcome_type, observed_at FROM r WHERE place = 1""")
def w1(spark, sf):
    return strongest_outcome(outcomes(spark, sf), STRENGTH).select("letter_id", "outcome_type", "observed_at")
