"""Targets, profiles, invariants and monitoring steps (X, R, A, U, T, K, P) over the mapped tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.functions import expressions as X
from ledgertide.operators import integrity
from ledgertide.operators import joins as J
from ledgertide.operators.aggregates import money
from ledgertide.plans.domain import I, L, O, R, S, T, high_risk, issuers, labels, letters, load, outcomes, snapshots, transfers
from ledgertide.plans.registry import query
from ledgertide.sources import landing

#: What a mixer, a gateway or a builder is, by its own table.
POOLS = "CASE s_suppkey % 3 WHEN 0 THEN 'tornado' WHEN 1 THEN 'wasabi' ELSE 'other' END"


@query("p7_mixers_by_type", f"WITH {T}, pools AS (SELECT s_suppkey AS dst, {POOLS} AS mixer_type FROM supplier WHERE s_suppkey % 13 = 0) SELECT mixer_type, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd FROM t JOIN pools USING (dst) GROUP BY mixer_type")
def p7(spark, sf):
    pools = load(spark, sf, "supplier").where("s_suppkey % 13 = 0").selectExpr("s_suppkey AS dst", f"{POOLS} AS mixer_type")
    return transfers(spark, sf).join(pools, "dst").groupBy("mixer_type").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"))


@query("p8_lightning_gateways", f"WITH {T}, g AS (SELECT s_suppkey AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'exchange' ELSE 'wallet' END AS operator_type FROM supplier WHERE s_suppkey % 19 = 0) SELECT operator_type, count(*) AS n, count(DISTINCT src) AS n_sources FROM t JOIN g USING (dst) WHERE chain = 'N' GROUP BY operator_type")
def p8(spark, sf):
    gateways = load(spark, sf, "supplier").where("s_suppkey % 19 = 0").selectExpr("s_suppkey AS dst", "CASE WHEN s_suppkey % 2 = 0 THEN 'exchange' ELSE 'wallet' END AS operator_type")
    return transfers(spark, sf).where("chain = 'N'").join(gateways, "dst").groupBy("operator_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_sources"))


@query("p9_mev_builders", f"WITH {T} SELECT src, chain, count(*) AS n, s_name AS builder, src % 46 = 0 AS verified FROM t JOIN supplier ON src = s_suppkey WHERE src % 23 = 0 AND chain <> 'N' GROUP BY ALL")
def p9(spark, sf):
    builders = load(spark, sf, "supplier").where("s_suppkey % 23 = 0").select(F.col("s_suppkey").alias("src"), F.col("s_name").alias("builder"), (F.col("s_suppkey") % 46 == 0).alias("verified"))
    return transfers(spark, sf).where("chain <> 'N'").groupBy("src", "chain").agg(F.count(F.lit(1)).alias("n")).join(builders, "src")


@query("p10_placeholders_and_confusables", "SELECT c_custkey % 3 = 0 AS placeholder, c_custkey % 4 = 0 AS confusable, count(*) AS n FROM customer GROUP BY ALL")
def p10(spark, sf):
    """Also P11: synthetic addresses carry a colon, look-alike symbols a letter beyond ASCII."""
    address = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("sui:"), "c_name")).otherwise(F.col("c_name"))
    symbol = F.when(F.col("c_custkey") % 4 == 0, F.lit("USDС")).otherwise(F.lit("USDC"))
    return load(spark, sf, "customer").groupBy(X.is_placeholder(address).alias("placeholder"), X.is_confusable(symbol).alias("confusable")).agg(F.count(F.lit(1)).alias("n"))


@query("p14_case_index", """WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'no victim record' WHEN 1 THEN 'empty name' WHEN 2 THEN 'test name' ELSE '' END AS reason FROM customer) SELECT reason, reason <> '' AS is_test, count(*) AS n, sum(count(*)) OVER () AS total FROM a GROUP BY reason""")
def p14(spark, sf):
    victim = F.when(F.col("c_custkey") % 5 == 1, F.lit("  ")).when(F.col("c_custkey") % 5 == 2, F.lit("Jane (Test Case)")).when(F.col("c_custkey") % 5 > 2, F.col("c_name"))
    rows = load(spark, sf, "customer").groupBy(X.fixture_reason(victim).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("reason", (F.col("reason") != "").alias("is_test"), "n", "total")


@query("p15_dust_list_filter", f"""WITH {T}, {L}, few AS (SELECT src FROM t GROUP BY src HAVING count(DISTINCT dst) >= 30 AND max(usd) < 110000), u AS (SELECT dst, count(*) AS n FROM t WHERE dst NOT IN (SELECT address FROM labels) GROUP BY dst)
  SELECT dst, n FROM u WHERE dst NOT IN (SELECT src FROM few)""")
def p15(spark, sf):
    """Flagged senders leave the list of unlabelled addresses; their transfers stay."""
    t = transfers(spark, sf)
    flagged = t.groupBy("src").agg(F.count_distinct("dst").alias("k"), F.max("usd").alias("most")).where("k >= 30 AND most < 110000").select(F.col("src").alias("dst"))
    unlabelled = t.join(labels(spark, sf).select(F.col("address").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return unlabelled.join(flagged, "dst", "left_anti")


@query("p16_investigations", "SELECT o_orderkey, o_orderstatus, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '1-%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 25")
def p16(spark, sf):
    """One page, newest first, and how many there are; the page is the feature."""
    rows = load(spark, sf, "orders").where("o_orderstatus = 'F'").where(F.startswith(F.lower("o_orderpriority"), F.lit("1-")))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(25).limit(50)
    return page.select("o_orderkey", "o_orderstatus").crossJoin(F.broadcast(total))


@query("p18_scaled_amounts", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '.' || repeat('0', 17) || '5' AS amount FROM orders")
def p18(spark, sf):
    raw = F.concat(F.nullif(F.col("o_custkey").cast("string"), F.lit("0")), F.lit("0" * 17), F.lit("5"))
    return load(spark, sf, "orders").select("o_orderkey", X.scaled_amount(F.coalesce(raw, F.lit("5")), F.lit(18)).alias("amount"))


@query("p19_sanitised_text", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '#' WHEN c_custkey % 3 = 1 THEN 'https://a.org/' || c_custkey ELSE '/case/' || c_custkey END AS url FROM customer")
def p19(spark, sf):
    """Also F23: control, direction and zero-width characters go; only harmless schemes stay."""
    dirty = F.concat(F.lit("‮"), F.left("c_name", F.lit(3)), F.lit("​\u0007"), F.substring("c_name", 4, 99))
    url = F.when(F.col("c_custkey") % 3 == 0, F.lit(" JavaScript:alert(1)")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://a.org/"), "c_custkey")).otherwise(F.concat(F.lit("/case/"), "c_custkey"))
    return load(spark, sf, "customer").select("c_custkey", X.scrub(dirty).alias("name"), X.safe_url(url).alias("url"))


@query("f7_multi_source_confirmation", """WITH c AS (SELECT o_custkey AS address, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS sources, count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'h' ELSE 'l' END) AS tiers, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high FROM orders WHERE o_orderkey % 4 < 2 GROUP BY o_custkey),
  d AS (SELECT *, len(sources) AS n, address % 2 = 0 AS impact, address % 6 = 0 AS tron FROM c)
  SELECT address, array_to_string(sources, '|') AS sources, CASE WHEN NOT impact THEN CASE WHEN n >= 2 THEN 'medium' ELSE 'low' END WHEN tron AND NOT high THEN 'low' WHEN tiers >= 2 OR (high AND n >= 2) THEN 'high' WHEN high THEN 'medium' ELSE 'low' END AS confidence,
    NOT impact OR (NOT (tron AND NOT high) AND (tiers >= 2 OR (high AND n >= 2))) AS accepted FROM d""")
def f7(spark, sf):
    seen = load(spark, sf, "orders").where("o_orderkey % 4 < 2").groupBy(F.col("o_custkey").alias("address")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("sources"))  # as many as there are sources
    verdict = X.confirmation(F.col("sources"), ("1-URGENT", "2-HIGH"), F.col("address") % 2 == 0, F.col("address") % 6 == 0)
    return seen.select("address", F.array_join("sources", "|").alias("sources"), verdict.alias("v")).select("address", "sources", "v.*")


@query("f8_label_freshness", """WITH a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN greatest(0, date_diff('day', TIMESTAMP '2024-01-01' - to_days(CAST(s_suppkey % 100 AS INTEGER)), TIMESTAMP '2024-01-01')) END AS age_days, CASE s_suppkey % 3 WHEN 0 THEN 30 ELSE s_suppkey % 3 * 14 END AS sla FROM supplier)
  SELECT s_suppkey, age_days, CASE WHEN age_days IS NULL THEN 'unknown' WHEN age_days > 2 * sla THEN 'critical' WHEN age_days > sla THEN 'stale' ELSE 'fresh' END AS status FROM a""")
def f8(spark, sf):
    updated = F.when(F.col("s_suppkey") % 5 > 0, F.expr("timestampadd(DAY, CAST(-(s_suppkey % 100) AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"))
    rows = load(spark, sf, "supplier").select("s_suppkey", updated.alias("updated"), (F.col("s_suppkey") % 3 * 14).alias("sla"))
    return rows.select("s_suppkey", X.freshness(F.col("updated"), F.col("sla"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).alias("f")).select("s_suppkey", "f.*")


# ---- alerts from changes of snapshots

_CHANGES = f"""WITH {S}, c AS (SELECT watch_id, event_id, usd_value - lag(usd_value) OVER w AS delta, tx_count - lag(tx_count) OVER w AS tx_delta, date_diff('day', lag(taken_at) OVER w, taken_at) AS dormant, watch_id % 3 = 0 AS freezable
    FROM snapshots WINDOW w AS (PARTITION BY watch_id ORDER BY taken_at, event_id)),
  k AS (SELECT *, CASE WHEN delta < 0 AND freezable THEN 'freezable_outflow' WHEN delta < 0 THEN 'tracked_outflow' WHEN dormant >= 3 THEN 'dormant_reactivation' WHEN delta > 0 AND freezable THEN 'freezable_inflow' END AS kind FROM c WHERE abs(delta) >= 40 OR tx_delta > 60),
  alerts AS (SELECT *, CASE WHEN kind LIKE '%outflow' THEN 'critical' ELSE 'high' END AS severity FROM k WHERE kind IS NOT NULL)"""


def recovery_alerts(spark, sf) -> DataFrame:
    """Material changes of a watch's snapshots as alerts: kind and severity."""
    w = Window.partitionBy("watch_id").orderBy("taken_at", "event_id")
    before = lambda c: F.lag(c).over(w)
    changes = snapshots(spark, sf).select("watch_id", "event_id", (F.col("usd_value") - before("usd_value")).alias("delta"), (F.col("tx_count") - before("tx_count")).alias("tx_delta"), F.datediff("taken_at", before("taken_at")).alias("dormant"), (F.col("watch_id") % 3 == 0).alias("freezable"))
    kind = F.when((F.col("delta") < 0) & F.col("freezable"), "freezable_outflow").when(F.col("delta") < 0, "tracked_outflow").when(F.col("dormant") >= 3, "dormant_reactivation").when((F.col("delta") > 0) & F.col("freezable"), "freezable_inflow")
    found = changes.where("abs(delta) >= 40 OR tx_delta > 60").withColumn("kind", kind).where("kind IS NOT NULL")
    return found.withColumn("severity", F.when(F.endswith("kind", F.lit("outflow")), "critical").otherwise("high"))


@query("t4_alert_rank", f"{_CHANGES} SELECT event_id, kind, severity, CAST(delta AS DOUBLE) AS delta FROM alerts ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, abs(delta) DESC, event_id LIMIT 100")
def t4(spark, sf):
    """The hundred most urgent; the cap is the report's own."""
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return recovery_alerts(spark, sf).orderBy(rank, F.desc(F.abs("delta")), "event_id").limit(100).select("event_id", "kind", "severity", money(F.col("delta")).alias("delta"))


@query("r13_freeze_drafts", f"{_CHANGES} SELECT watch_id, kind, count(*) AS n, CAST(sum(abs(delta)) AS DOUBLE) AS usd FROM alerts WHERE kind LIKE 'freezable%' AND watch_id % 5 <> 0 GROUP BY ALL")
def r13(spark, sf):
    """Only alerts on freezable funds that belong to a case."""
    return recovery_alerts(spark, sf).where("kind LIKE 'freezable%' AND watch_id % 5 <> 0").groupBy("watch_id", "kind").agg(F.count(F.lit(1)).alias("n"), money(F.sum(F.abs("delta"))).alias("usd"))


@query("r12_incident_plans", f"""{_CHANGES}, q AS (SELECT event_id, kind, unnest(range(1, CASE WHEN kind = 'freezable_outflow' THEN 5 WHEN severity = 'critical' THEN 4 ELSE 3 END)) AS step_no FROM alerts)
  SELECT event_id, step_no, CASE WHEN step_no = 1 THEN 'preserve' WHEN step_no = 2 THEN 'retrace' WHEN step_no = 3 AND kind = 'freezable_outflow' THEN 'freeze' ELSE 'report' END AS step FROM q""")
def r12(spark, sf):
    """Ordered steps by what the alert is."""
    steps = F.when(F.col("kind") == "freezable_outflow", F.array(*map(F.lit, ("preserve", "retrace", "freeze", "report")))).when(F.col("severity") == "critical", F.array(*map(F.lit, ("preserve", "retrace", "report")))).otherwise(F.array(*map(F.lit, ("preserve", "retrace"))))
    return recovery_alerts(spark, sf).select("event_id", F.posexplode(steps).alias("at", "step")).select("event_id", (F.col("at") + 1).cast("long").alias("step_no"), "step")


@query("r4_eligible_watches", f"""WITH {S}, l AS (SELECT watch_id, max(taken_at) AS last FROM snapshots GROUP BY watch_id) SELECT watch_id, CASE watch_id % 4 WHEN 0 THEN 'hot' ELSE 'standard' END AS state FROM l WHERE watch_id % 4 <> 3 AND last <= TIMESTAMP '2024-01-31 00:00:00' - CASE watch_id % 4 WHEN 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 12 HOUR END""")
def r4(spark, sf):
    """Hot watches are due after an hour, standard ones after twelve, paused ones never."""
    last = snapshots(spark, sf).groupBy("watch_id").agg(F.max("taken_at").alias("last"))
    state = F.when(F.col("watch_id") % 4 == 0, "hot").when(F.col("watch_id") % 4 == 3, "paused").otherwise("standard")
    hours = F.when(F.col("state") == "hot", 1).otherwise(12)
    due = F.timestamp_add("HOUR", hours, F.col("last")) <= F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return last.withColumn("state", state).where("state <> 'paused'").where(due).select("watch_id", "state")


@query("r9_settled_outbound", f"WITH {T}, {L} SELECT tx_hash, log_index, src, dst, CASE WHEN category = 'exchange' THEN name END AS exchange, coalesce(category = 'exchange', false) AS freezable, count(*) AS n FROM t LEFT JOIN labels ON dst = address WHERE src % 10 = 1 AND token % 4 = 0 AND amt > 0 AND block_time >= TIMESTAMP '1997-01-01' GROUP BY ALL")
def r9(spark, sf):
    """Also X2: what watched senders paid in one token since a date, and the exchange it went to, if any."""
    watched = load(spark, sf, "supplier").where("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("src"))
    watched = watched.union(load(spark, sf, "customer").where("c_custkey % 10 = 1").select("c_custkey")).distinct()
    exchanges = labels(spark, sf).where("category = 'exchange'").select(F.col("address").alias("dst"), F.col("name").alias("exchange"))
    paid = transfers(spark, sf).where("token % 4 = 0 AND amt > 0 AND block_time >= TIMESTAMP_NTZ '1997-01-01 00:00:00'").join(watched, "src", "left_semi")
    return paid.join(exchanges, "dst", "left").groupBy("tx_hash", "log_index", "src", "dst", "exchange", F.col("exchange").isNotNull().alias("freezable")).agg(F.count(F.lit(1)).alias("n"))


@query("r14_auto_subscriptions", f"WITH {T}, {R} SELECT dst AS address, chain, CAST(greatest(1000, max(usd) / 10) AS DOUBLE) AS threshold, bool_or(risk_category IS NOT NULL) AS risky FROM t LEFT JOIN high_risk ON dst = address WHERE usd > 50000 GROUP BY dst, chain")
def r14(spark, sf):
    """One subscription an address and chain, with a threshold from what it held."""
    risky = high_risk(spark, sf).select(F.col("address").alias("dst"), F.lit(True).alias("risky"))
    rows = transfers(spark, sf).where("usd > 50000").join(risky, "dst", "left")
    return rows.groupBy(F.col("dst").alias("address"), "chain").agg(money(F.greatest(F.lit(1000).cast("decimal(30,5)"), F.max("usd").cast("decimal(30,5)") / 10)).alias("threshold"), F.coalesce(F.bool_or("risky"), F.lit(False)).alias("risky"))


@query("r15_wallet_guard", """WITH b AS (SELECT c_custkey, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 40) AS x FROM customer) SELECT c_custkey, c_custkey % 3 = 0 AS known, c_custkey % 3 = 1 AS lookalike FROM b""")
def r15(spark, sf):
    """An address to be paid against the one in the book: the same, one that only shows the same ends, or another."""
    book = F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).substr(1, 40)
    paid = F.when(F.col("c_custkey") % 3 == 0, F.upper(book)).when(F.col("c_custkey") % 3 == 1, F.concat(F.left(book, F.lit(4)), F.lit("0" * 32), F.right(book, F.lit(4)))).otherwise(F.lit("f" * 40))
    rows = load(spark, sf, "customer").select("c_custkey", X.shape_similarity(F.concat(F.lit("0x"), paid), F.concat(F.lit("0x"), book)).alias("s"))
    return rows.select("c_custkey", (F.col("s") == 1).alias("known"), ((F.col("s") >= 0.95) & (F.col("s") < 1)).alias("lookalike"))


@query("r19_stale_reviews", f"WITH {O}, d AS (SELECT letter_id, max(observed_at) AS last FROM outcomes GROUP BY letter_id) SELECT letter_id, date_diff('day', coalesce(last, sent_at), TIMESTAMP '1999-01-01') AS age_days, last IS NULL AS silent FROM letters LEFT JOIN d USING (letter_id) WHERE date_diff('day', coalesce(last, sent_at), TIMESTAMP '1999-01-01') > CASE WHEN last IS NULL THEN 30 ELSE 90 END")
def r19(spark, sf):
    last = outcomes(spark, sf).groupBy("letter_id").agg(F.max("observed_at").alias("last"))
    rows = letters(spark, sf).join(last, "letter_id", "left").withColumn("silent", F.col("last").isNull())
    rows = rows.withColumn("age_days", F.datediff(F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'"), F.coalesce("last", "sent_at")).cast("long"))
    return rows.where(F.col("age_days") > F.when(F.col("silent"), 30).otherwise(90)).select("letter_id", "age_days", "silent")


@query("r2_monitor_tick", f"""WITH {S}, cur AS (SELECT watch_id, max(event_id) AS cursor FROM snapshots WHERE taken_at < TIMESTAMP '2024-01-10' AND watch_id % 5 > 0 GROUP BY watch_id), a AS (SELECT s.*, CASE watch_id % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'threshold' ELSE 'kind' END AS trigger FROM snapshots s JOIN cur USING (watch_id) WHERE event_id > cursor)
  SELECT watch_id, trigger, count(*) AS n_alerts, CAST(max(event_id) AS BIGINT) AS newest FROM a WHERE trigger = 'any' OR (trigger = 'threshold' AND usd_value >= 50) OR (trigger = 'kind' AND event_type = 'click') GROUP BY ALL""")
def r2(spark, sf):
    """Also R1: activities after each subscription's cursor, by its trigger; a watch without a cursor replays nothing."""
    rows = snapshots(spark, sf)
    cursors = rows.where("taken_at < TIMESTAMP_NTZ '2024-01-10 00:00:00' AND watch_id % 5 > 0").groupBy("watch_id").agg(F.max("event_id").alias("cursor"))
    new = rows.join(cursors, "watch_id").where("event_id > cursor").withColumn("trigger", F.when(F.col("watch_id") % 3 == 0, "any").when(F.col("watch_id") % 3 == 1, "threshold").otherwise("kind"))
    hit = new.where("trigger = 'any' OR (trigger = 'threshold' AND usd_value >= 50) OR (trigger = 'kind' AND event_type = 'click')")
    return hit.groupBy("watch_id", "trigger").agg(F.count(F.lit(1)).alias("n_alerts"), F.max("event_id").cast("long").alias("newest"))


# ---- profiles and targets

@query("x7_inspection", f"""WITH {T}, a AS (SELECT src AS address, dst AS other, block_time FROM t UNION ALL SELECT dst, src, block_time FROM t), c AS (SELECT address, other, count(*) AS n, min(block_time) AS f, max(block_time) AS l FROM a GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY n DESC, other) AS place FROM c)
  SELECT address, CAST(sum(n) AS BIGINT) AS n_transfers, count(*) AS n_counterparties, min(f) AS first_seen, max(l) AS last_seen, string_agg(other || ':' || n, ',' ORDER BY place) FILTER (WHERE place <= 5) AS top, CASE WHEN count(*) > 80 THEN 'service' ELSE 'wallet' END AS identity FROM k GROUP BY address""")
def x7(spark, sf):
    """Counts, span of time, the five busiest counterparties (the report's own number) and a guess."""
    t = transfers(spark, sf)
    legs = t.select(F.explode(F.array(F.struct(F.col("src").alias("address"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("address"), F.col("src").alias("other")))).alias("l"), "block_time").select("l.*", "block_time")
    pairs = legs.groupBy("address", "other").agg(F.count(F.lit(1)).alias("n"), F.min("block_time").alias("f"), F.max("block_time").alias("l"))
    place = F.row_number().over(Window.partitionBy("address").orderBy(F.desc("n"), "other"))
    ranked = pairs.withColumn("place", place)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", F.concat_ws(":", F.col("other").cast("string"), F.col("n").cast("string")).alias("s"))))), lambda x: x["s"]), ",")
    return ranked.groupBy("address").agg(F.sum("n").alias("n_transfers"), F.count(F.lit(1)).alias("n_counterparties"), F.min("f").alias("first_seen"), F.max("l").alias("last_seen"), top.alias("top"), F.when(F.count(F.lit(1)) > 80, "service").otherwise("wallet").alias("identity"))


@query("x8_dormant", f"""WITH {T}, {L}, i AS (SELECT dst AS address, token, sum(amt) AS got, max(block_time) AS last, max(usd / amt) AS price FROM t GROUP BY ALL), o AS (SELECT src AS address, token, sum(amt) AS paid FROM t GROUP BY ALL), b AS (SELECT i.address, i.token, got - coalesce(paid, 0) AS balance, last, price FROM i LEFT JOIN o USING (address, token))
  SELECT address, count(*) AS n_tokens, CAST(round(sum(balance * CAST(price AS DOUBLE)), 0) AS BIGINT) AS usd FROM b WHERE balance > 0 AND address NOT IN (SELECT address FROM labels WHERE category <> 'defi') GROUP BY address HAVING sum(balance * CAST(price AS DOUBLE)) >= 10000 AND max(last) < TIMESTAMP '1999-01-01'""")
def x8(spark, sf):
    """Balances that were received and not moved on, at the highest price seen, of addresses that are no service."""
    t = transfers(spark, sf)
    got = t.groupBy(F.col("dst").alias("address"), "token").agg(F.sum("amt").alias("got"), F.max("block_time").alias("last"), F.max(F.col("usd").cast("double") / F.col("amt").cast("double")).alias("price"))
    paid = t.groupBy(F.col("src").alias("address"), "token").agg(F.sum("amt").alias("paid"))
    held = got.join(paid, ["address", "token"], "left").withColumn("balance", F.col("got") - F.coalesce("paid", F.lit(0))).where("balance > 0")
    held = held.join(labels(spark, sf).where("category <> 'defi'").select("address"), "address", "left_anti")
    rolled = held.groupBy("address").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("balance").cast("double") * F.col("price")).alias("value"), F.max("last").alias("last"))
    return rolled.where("value >= 10000 AND last < TIMESTAMP_NTZ '1999-01-01 00:00:00'").select("address", "n_tokens", F.round("value", 0).cast("long").alias("usd"))


@query("x9_address_profiles", f"""WITH {L}, {R}, a AS (SELECT s_suppkey AS address, risk_category, severity, category FROM supplier LEFT JOIN high_risk h ON s_suppkey = h.address LEFT JOIN labels l ON s_suppkey = l.address), v AS (SELECT *, CASE WHEN severity = 3 THEN 'critical' WHEN severity = 2 THEN 'high' WHEN severity = 1 THEN 'medium' WHEN category = 'mixer' THEN 'high' WHEN category = 'bridge' THEN 'low' ELSE 'clean' END AS verdict FROM a)
  SELECT address, verdict, upper(verdict) AS risk_band, concat_ws('|', CASE WHEN risk_category = 'ofac_sanctioned' THEN 'Sanctioned' WHEN risk_category = 'ransomware' THEN 'Ransomware' WHEN risk_category = 'drainer' THEN 'Drainer' END, CASE WHEN category = 'mixer' THEN 'Mixer' END) AS tags,
    risk_category IS NOT NULL OR coalesce(category = 'mixer', false) OR verdict NOT IN ('clean', 'low') AS flagged FROM v""")
def x9(spark, sf):
    """Also X6, the screening of many addresses at once."""
    return address_profiles(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("address")), labels(spark, sf), high_risk(spark, sf))


def address_profiles(addresses: DataFrame, known: DataFrame, risky: DataFrame) -> DataFrame:
    """Verdict, band, exposure tags and flag of each address."""
    rows = addresses.join(risky.select("address", "risk_category", "severity"), "address", "left").join(known.select("address", "category"), "address", "left")
    verdict = F.when(F.col("severity") == 3, "critical").when(F.col("severity") == 2, "high").when(F.col("severity") == 1, "medium").when(F.col("category") == "mixer", "high").when(F.col("category") == "bridge", "low").otherwise("clean")
    risk = F.when(F.col("risk_category") == "ofac_sanctioned", "Sanctioned").when(F.col("risk_category") == "ransomware", "Ransomware").when(F.col("risk_category") == "drainer", "Drainer")
    tags = F.concat_ws("|", risk, F.when(F.col("category") == "mixer", "Mixer"))
    flagged = (tags != "") | ~F.col("verdict").isin("clean", "low")
    return rows.withColumn("verdict", verdict).select("address", "verdict", F.upper("verdict").alias("risk_band"), tags.alias("tags"), flagged.alias("flagged"))


@query("x10_subpoena_targets", f"""WITH {T}, {L}, {I}, d AS (SELECT dst, token, sum(usd) AS usd FROM t GROUP BY ALL), k AS (SELECT d.*, category, name, issuer FROM d LEFT JOIN labels ON dst = address LEFT JOIN issuers ON d.token = issuers.token AND freeze_capability <> 'no')
  SELECT CASE WHEN category = 'exchange' THEN 'exchange' WHEN category = 'bridge' THEN 'bridge' ELSE 'unhosted' END AS recipient_kind, coalesce(CASE WHEN category IN ('exchange', 'bridge') THEN name END, '-') AS recipient, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd, coalesce(category = 'bridge', false) AS needs_trace FROM k WHERE issuer IS NULL GROUP BY ALL""")
def x10(spark, sf):
    """Destinations that no issuer can freeze, by who can be asked about them."""
    sums = transfers(spark, sf).groupBy("dst", "token").agg(F.sum("usd").alias("usd"))
    unfreezable = sums.join(issuers(spark, sf).where("freeze_capability <> 'no'").select("token"), "token", "left_anti")
    rows = unfreezable.join(labels(spark, sf).select(F.col("address").alias("dst"), "category", "name"), "dst", "left")
    kind = F.when(F.col("category") == "exchange", "exchange").when(F.col("category") == "bridge", "bridge").otherwise("unhosted")
    rows = rows.select(kind.alias("recipient_kind"), F.when(F.col("category").isin("exchange", "bridge"), F.col("name")).otherwise("-").alias("recipient"), "usd", F.coalesce(F.col("category") == "bridge", F.lit(False)).alias("needs_trace"))
    return rows.groupBy("recipient_kind", "recipient", "needs_trace").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"))


@query("x11_findings", f"""WITH {T}, {L}, {R}, f AS (SELECT DISTINCT 'destination' AS section, dst AS address FROM t WHERE usd > 90000 UNION ALL SELECT DISTINCT 'exchange', dst FROM t JOIN labels ON dst = address WHERE category = 'exchange' UNION ALL SELECT DISTINCT 'bridge', dst FROM t JOIN labels ON dst = address WHERE category = 'bridge' UNION ALL SELECT DISTINCT 'risk', dst FROM t JOIN high_risk ON dst = address)
  SELECT address, arg_min(section, CASE section WHEN 'risk' THEN 0 WHEN 'exchange' THEN 1 WHEN 'bridge' THEN 2 ELSE 3 END) AS section, count(*) AS n_sections FROM f GROUP BY address""")
def x11(spark, sf):
    """Sections in the order in which they count; an address keeps its first."""
    t, known = transfers(spark, sf), labels(spark, sf)
    of = lambda df, rank, name: df.select(F.lit(rank).alias("rank"), F.lit(name).alias("section"), F.col("dst").alias("address")).distinct()
    named = t.join(known.select(F.col("address").alias("dst"), "category"), "dst")
    parts = [of(t.join(high_risk(spark, sf).select(F.col("address").alias("dst")), "dst", "left_semi"), 0, "risk"), of(named.where("category = 'exchange'"), 1, "exchange"), of(named.where("category = 'bridge'"), 2, "bridge"), of(t.where("usd > 90000"), 3, "destination")]
    return reduce(DataFrame.unionByName, parts).groupBy("address").agg(F.min_by("section", "rank").alias("section"), F.count(F.lit(1)).alias("n_sections"))


@query("x12_legal_requests", f"WITH {T}, {L}, d AS (SELECT name, dst, sum(usd) AS usd FROM t JOIN labels ON dst = address WHERE category = 'exchange' GROUP BY ALL) SELECT name AS exchange, count(*) AS n_deposits, string_agg(CAST(dst AS VARCHAR), '|' ORDER BY dst) AS deposits, CAST(sum(usd) AS DOUBLE) AS usd FROM d GROUP BY name")
def x12(spark, sf):
    exchanges = labels(spark, sf).where("category = 'exchange'").select(F.col("address").alias("dst"), F.col("name").alias("exchange"))
    sums = transfers(spark, sf).join(exchanges, "dst").groupBy("exchange", "dst").agg(F.sum("usd").alias("usd"))
    deposits = F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: x.cast("string")), "|")  # one exchange's own deposit addresses
    return sums.groupBy("exchange").agg(F.count(F.lit(1)).alias("n_deposits"), deposits.alias("deposits"), money(F.sum("usd")).alias("usd"))


@query("x13_report_subjects", f"WITH {T}, {R} SELECT dst AS subject, risk_category, min(block_time) AS date_from, max(block_time) AS date_to, CAST(sum(usd) AS DOUBLE) AS usd FROM t JOIN high_risk ON dst = address GROUP BY ALL")
def x13(spark, sf):
    risky = high_risk(spark, sf).select(F.col("address").alias("subject"), "risk_category")
    rows = transfers(spark, sf).withColumnRenamed("dst", "subject").join(risky, "subject")
    return rows.groupBy("subject", "risk_category").agg(F.min("block_time").alias("date_from"), F.max("block_time").alias("date_to"), money(F.sum("usd")).alias("usd"))


@query("x14_exhibits", """WITH a AS (SELECT c_name AS file, c_nationkey AS case_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS i FROM customer) SELECT case_id, file, 'Exhibit ' || CASE WHEN i >= 18278 THEN chr(CAST(65 + (i - 18278) // 17576 AS INTEGER)) ELSE '' END || CASE WHEN i >= 702 THEN chr(CAST(65 + (i - 702) // 676 % 26 AS INTEGER)) ELSE '' END || CASE WHEN i >= 26 THEN chr(CAST(65 + (i - 26) // 26 % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + i % 26 AS INTEGER)) AS label, sha256(file) AS sha256 FROM a""")
def x14(spark, sf):
    """Files of each case in order, lettered as spreadsheets letter columns."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("file")) - 1
    rows = load(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_name").alias("file"))
    return rows.withColumn("i", place).select("case_id", "file", F.concat(F.lit("Exhibit "), X.exhibit_letter(F.col("i"))).alias("label"), F.sha2(F.col("file").cast("binary"), 256).alias("sha256"))


@query("x16_sum_coherence", f"""WITH {O}, p AS (SELECT letter_id, sum(coalesce(frozen_usd, 0) + coalesce(returned_usd, 0)) AS parts FROM outcomes GROUP BY letter_id) SELECT letter_id, CAST(requested_usd - parts AS DOUBLE) AS gap FROM letters JOIN p USING (letter_id) WHERE requested_usd > 0 AND parts > 0 AND abs(requested_usd - parts) > 100""")
def x16(spark, sf):
    """Letters whose parts don't add up to what was asked, by more than 100."""
    parts = outcomes(spark, sf).groupBy("letter_id").agg(F.sum(F.coalesce("frozen_usd", F.lit(0)) + F.coalesce("returned_usd", F.lit(0))).alias("parts"))
    rows = letters(spark, sf).join(parts, "letter_id").withColumn("gap", F.col("requested_usd") - F.col("parts"))
    return rows.where("requested_usd > 0 AND parts > 0 AND abs(gap) > 100").select("letter_id", money(F.col("gap")).alias("gap"))


@query("x8_dormant_holdings", f"""WITH {T}, {L}, {I}, c AS (SELECT dst AS address, token, usd FROM t WHERE dst % 10 <> 1 AND dst NOT IN (SELECT address FROM labels WHERE category IN ('exchange', 'mixer', 'bridge'))),
  f AS (SELECT address, sum(usd) AS inflow, count(*) AS n FROM c GROUP BY address),
  b AS (SELECT l_suppkey AS address, l_partkey AS token, sum(CAST(l_quantity AS DECIMAL(12,2))) AS amount FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
  h AS (SELECT b.*, CASE WHEN token % 4 <> 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) END AS price FROM b JOIN part ON p_partkey = token WHERE (address, token) IN (SELECT (address, token) FROM c) OR token IN (SELECT token FROM issuers WHERE freeze_capability = 'yes'))
  SELECT address, count(*) AS n_holdings, count(*) FILTER (WHERE price IS NULL) AS n_unpriced, CAST(sum(amount * price) AS DOUBLE) AS total_usd, CAST(any_value(inflow) AS DOUBLE) AS inflow_usd, any_value(f.n) AS inflow_count
  FROM h JOIN f USING (address) GROUP BY address HAVING sum(amount * price) >= 10000""")
def x8_holdings(spark, sf):
    """Open lines are balances; a token is looked at if the address got it or an issuer can freeze it; every fourth
    has no price."""
    lines = load(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("address"), F.col("l_partkey").alias("token")).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("amount"))
    prices = load(spark, sf, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("token"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    seeds = load(spark, sf, "supplier").where("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("address"))
    found = J.dormant_holdings(transfers(spark, sf), lines, issuers(spark, sf).where("freeze_capability = 'yes'"), prices, seeds, labels(spark, sf))
    return found.select("address", "n_holdings", "n_unpriced", money(F.col("total_usd")).alias("total_usd"), money(F.col("inflow_usd")).alias("inflow_usd"), "inflow_count")


@query("x15_set_consistency", f"""WITH {T}, {I}, asked AS (SELECT DISTINCT issuer, dst FROM t JOIN issuers USING (token) WHERE freeze_capability = 'yes'), held AS (SELECT DISTINCT issuer, dst FROM t JOIN issuers USING (token) WHERE freeze_capability = 'yes' AND usd > 20000)
  SELECT issuer, count(*) AS n_missing FROM asked WHERE (issuer, dst) NOT IN (SELECT (issuer, dst) FROM held) GROUP BY issuer""")
def x15(spark, sf):
    """Addresses that a letter cites and the brief doesn't list, by issuer."""
    rows = transfers(spark, sf).join(issuers(spark, sf).where("freeze_capability = 'yes'"), "token")
    asked, listed = rows.select("issuer", "dst").distinct(), rows.where("usd > 20000").select("issuer", "dst")
    return asked.join(listed, ["issuer", "dst"], "left_anti").groupBy("issuer").agg(F.count(F.lit(1)).alias("n_missing"))


_HEX40 = "'0x' || lower(lpad(printf('%x', {0}), 40, '0'))"


@query("x15_violations", f"""WITH leads AS (SELECT o_orderkey, o_custkey AS case_id, {_HEX40.format('o_orderkey')} AS address, count(DISTINCT l_returnflag) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 2 WHERE o_orderpriority[:1] IN ('1', '2') GROUP BY ALL),
  lines AS (SELECT o_custkey AS case_id, 'issuer' || l_partkey % 7 AS issuer, 'T' || l_partkey AS token, {_HEX40.format('l_suppkey')} AS address, CAST(l_extendedprice AS DECIMAL(20,2)) AS usd, l_returnflag AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  listed AS (SELECT case_id, issuer, token, address, max(usd) AS usd FROM lines WHERE flag <> 'A' GROUP BY ALL), k AS (SELECT a.*, l.usd AS listed FROM lines a LEFT JOIN listed l USING (case_id, issuer, token, address) WHERE a.flag <> 'N')
  SELECT DISTINCT case_id, 'H' AS check_id, 'critical' AS severity, address AS subject FROM leads WHERE n < 2
  UNION SELECT case_id, 'H', 'warning', 'recovery rate' FROM leads JOIN customer ON c_custkey = case_id WHERE c_nationkey % 10 < 5
  UNION SELECT case_id, 'K', 'critical', issuer || ' ' || token || ' ' || address FROM k WHERE listed IS NULL OR abs(usd - listed) > 10
  UNION SELECT o_custkey, 'L', 'critical', {_HEX40.format('o_orderkey')} FROM orders WHERE o_orderkey % 3 > 0
  UNION SELECT o_orderkey, 'O', 'critical', {_HEX40.format('o_custkey')} FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey <> o_custkey
  UNION SELECT o_orderkey, 'O', 'critical', CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 1
  UNION SELECT o_orderkey, 'O', 'critical', 'solana' FROM orders WHERE o_orderkey % 11 = 0""")
def x15_violations(spark, sf):
    """Calibration, freeze asks, links and prose of all cases, checked at once."""
    hex40 = lambda c: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 40, "0")))
    orders, lines = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    kinds = lines.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("sources"))  # three flags at most
    leads = orders.join(kinds, "o_orderkey", "left").select(F.col("o_custkey").alias("case_id"), hex40("o_orderkey").alias("address"), F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), "high").otherwise("low").alias("confidence"), "sources")
    rates = load(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), ((F.col("c_nationkey") % 10) / 100.0).alias("wilson_lower"))
    asked = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("issuer"), F.col("l_partkey") % 7).alias("issuer"), F.concat(F.lit("t"), F.col("l_partkey")).alias("token"), hex40("l_suppkey").alias("address"), F.col("l_extendedprice").cast("decimal(20,2)").alias("usd"), "l_returnflag")
    base = F.when(F.col("o_orderkey") % 3 == 0, "https://etherscan.io/address/").when(F.col("o_orderkey") % 3 == 1, "https://www.arbiscan.io/address/").otherwise("https://tronscan.org/#/address/")
    links = orders.select(F.col("o_custkey").alias("case_id"), F.lit("brief.html").alias("file"), F.concat(base, hex40("o_orderkey")).alias("url"))
    chains = orders.select(F.col("o_custkey").alias("case_id"), hex40("o_orderkey").alias("address"), F.lit("ethereum").alias("chain"))
    case, price = F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").cast("decimal(20,2)")
    text = F.concat(F.lit("They paid $"), F.format_number(price, 2), F.lit(" on Ethereum to "), hex40("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" and "), hex40("o_custkey"))).otherwise(""), F.when(F.col("o_orderkey") % 11 == 0, " over solana.").otherwise("."))
    known = price.cast("double") * F.when(F.col("o_orderkey") % 7 == 1, 1.02).otherwise(1.0) + F.when(F.col("o_orderkey") % 7 == 1, 200.0).otherwise(50.0)
    found = integrity.violations(
        integrity.calibration(leads, rates), integrity.freeze_asks(asked.where("l_returnflag <> 'A'"), asked.where("l_returnflag <> 'N'")), integrity.explorer_links(links, chains),
        integrity.grounding(orders.select(case, text.alias("text")), orders.select(case, hex40("o_orderkey").alias("address")), orders.select(case, known.alias("usd")), orders.select(case, F.lit("ethereum").alias("chain"))),
    )
    return found.select("case_id", "check_id", "severity", "subject").distinct()


@query("x17_stale_labels", f"WITH {T}, {L} SELECT address, name, count(*) AS n FROM t JOIN labels ON dst = address WHERE valid_from > block_time GROUP BY ALL")
def x17(spark, sf):
    """Labels that are cited for a time before they held."""
    known = labels(spark, sf).where("valid_from IS NOT NULL").select("address", "name", "valid_from")
    return transfers(spark, sf).join(known, F.col("dst") == F.col("address")).where("valid_from > block_time").groupBy("address", "name").agg(F.count(F.lit(1)).alias("n"))


@query("u6_missing_destinations", f"WITH {T} SELECT DISTINCT s_suppkey AS address FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey NOT IN (SELECT dst FROM t WHERE usd > 80000)")
def u6(spark, sf):
    """Expected destinations less those that were produced: any row is a violation."""
    expected = load(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("address"))
    return expected.join(transfers(spark, sf).where("usd > 80000").select(F.col("dst").alias("address")), "address", "left_anti").distinct()


@query("a10_holdings", f"""WITH {T}, {I}, h AS (SELECT issuer, dst, freeze_capability, sum(usd) AS usd FROM t JOIN issuers USING (token) GROUP BY ALL), f AS (SELECT issuer, sum(usd) AS usd FROM h WHERE freeze_capability <> 'no' GROUP BY issuer), u AS (SELECT issuer, dst, max(usd) AS usd FROM h WHERE freeze_capability = 'no' GROUP BY ALL)
  SELECT issuer, CAST(sum(usd) AS DOUBLE) AS usd FROM (SELECT * FROM f UNION ALL SELECT issuer, usd FROM u) GROUP BY issuer""")
def a10(spark, sf):
    """Issuers' freezable totals, and what can't be frozen once for each issuer and address."""
    held = transfers(spark, sf).join(issuers(spark, sf), "token").groupBy("issuer", "dst", "freeze_capability").agg(F.sum("usd").alias("usd"))
    lost = held.where("freeze_capability = 'no'").groupBy("issuer", "dst").agg(F.max("usd").alias("usd")).select("issuer", "usd")
    return held.where("freeze_capability <> 'no'").select("issuer", "usd").unionByName(lost).groupBy("issuer").agg(money(F.sum("usd")).alias("usd"))


@query("t11_label_candidates", "SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS confidence FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def t11(spark, sf):
    """The review list's own page."""
    return load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("confidence"))


@query("k10_capped_candidates", "WITH n AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id % 4 > 0), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS place FROM n) SELECT event_id, day FROM k WHERE place <= 20")
def k10(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    old = load(spark, sf, "events").select("user_id").where("user_id % 4 = 0")
    return landing.capped_candidates(events, old, ["user_id"], "day", ["event_id"], 20).select("event_id", "day")


@query("k13_blacklist", "SELECT s_suppkey AS address, CASE WHEN s_suppkey % 6 = 0 THEN 'manual' ELSE 'auto' END AS reason FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0 OR s_suppkey % 6 = 0 AND s_suppkey % 10 <> 0")
def k13(spark, sf):
    """The list after arming every sixth address by hand and disarming every tenth."""
    base = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("address"))
    listed = base.where("address % 2 = 0").withColumn("reason", F.lit("auto")).withColumn("at", F.lit(1))
    armed = base.where("address % 6 = 0").withColumn("reason", F.lit("manual")).withColumn("at", F.lit(2))
    return landing.absent(landing.upsert(listed, armed, ["address"], ["at"]), base.where("address % 10 = 0"), ["address"]).select("address", "reason")


@query("k16_custody_chain", """WITH RECURSIVE e AS (SELECT c_nationkey AS case_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_name AS payload FROM customer), h AS (SELECT case_id, i, sha256(repeat('0', 64) || payload) AS hash FROM e WHERE i = 1 UNION ALL SELECT e.case_id, e.i, sha256(h.hash || e.payload) FROM h JOIN e ON e.case_id = h.case_id AND e.i = h.i + 1)
  SELECT case_id, max(i) AS entries, arg_max(hash, i) AS head FROM h GROUP BY case_id""")
def k16(spark, sf):
    """Each case's entries in order, every hash over the one before; a case's log is one row."""
    logs = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("log"))
    head = F.aggregate("log", F.lit("0" * 64), lambda h, e: F.sha2(F.concat(h, e["c_name"]).cast("binary"), 256))
    return logs.select("case_id", F.size("log").cast("long").alias("entries"), head.alias("head"))


@query("k15_price_table", f"WITH {T} SELECT token, CAST(block_time AS DATE) AS day, max(CAST(usd AS DOUBLE) / CAST(amt AS DOUBLE)) AS usd FROM t GROUP BY ALL")
def k15(spark, sf):
    """Also X1: a price of each token and day, which joins take instead of a cache."""
    return transfers(spark, sf).groupBy("token", F.to_date("block_time").alias("day")).agg(F.max(F.col("usd").cast("double") / F.col("amt").cast("double")).alias("usd"))


@query("s31_sanctions_entities", "WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 > 0) SELECT 'w' || o_orderkey AS address, 'N' || o_custkey AS name, 'id' || o_custkey AS entity FROM o")
def s31(spark, sf):
    """Entities whose properties are lists: the first name, a row for each wallet."""
    rows = load(spark, sf, "orders").where("o_orderkey % 3 > 0").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("w"), "o_orderkey")).alias("wallets"))  # a customer's own
    body = F.to_json(F.struct(F.concat(F.lit("id"), "o_custkey").alias("id"), F.lit("CryptoWallet").alias("schema"), F.struct(F.array(F.concat(F.lit("N"), "o_custkey"), F.lit("alias")).alias("name"), F.col("wallets").alias("publicKey")).alias("properties")))
    return landing.sanctions_entities(rows.select(body.alias("body"))).select("address", "name", "entity")


@query("s32_attribution_rows", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'no address' WHEN 1 THEN 'no category' ELSE 'kept' END AS outcome, count(*) AS n FROM orders GROUP BY ALL")
def s32(spark, sf):
    """Feeds name their columns differently; what is skipped is counted by its reason."""
    k = F.col("o_orderkey")
    rows = load(spark, sf, "orders").select(F.when(k % 5 > 1, F.concat(F.lit("0x"), k)).alias("wallet"), F.when(k % 5 == 1, F.concat(F.lit("0x"), k)).alias("addr"), F.when(k % 5 != 1, F.lit("scam")).alias("type"), F.lit("feed").alias("source"))
    return landing.attribution_rows(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s33_event_feeds", "SELECT feed, count(*) AS n, max(observed_at) AS newest FROM (SELECT 'government' AS feed, o_orderdate AS observed_at FROM orders UNION ALL SELECT 'market', l_shipdate FROM lineitem) WHERE observed_at >= TIMESTAMP '1997-01-01' GROUP BY feed")
def s33(spark, sf):
    feeds = {"government": load(spark, sf, "orders").select(F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").cast("string").alias("title")), "market": load(spark, sf, "lineitem").select(F.col("l_shipdate").alias("observed_at"), F.col("l_orderkey").cast("string").alias("title"))}
    return landing.event_feeds(feeds, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).groupBy("feed").agg(F.count(F.lit(1)).alias("n"), F.max("observed_at").alias("newest"))


@query("s26_router_scan", f"WITH {T}, r AS (SELECT p_partkey AS token, p_brand AS protocol FROM part WHERE p_size % 5 = 0) SELECT protocol, count(*) AS n FROM t JOIN r USING (token) GROUP BY protocol")
def s26(spark, sf):
    """Also S25, S27, S34: a dimension filtered by kind, joined to what touches it."""
    routers = load(spark, sf, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("token"), F.col("p_brand").alias("protocol"))
    return transfers(spark, sf).join(routers, "token").groupBy("protocol").agg(F.count(F.lit(1)).alias("n"))
