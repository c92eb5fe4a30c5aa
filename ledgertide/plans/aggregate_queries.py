"""Aggregations (A) over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgertide.operators import aggregates as A
from ledgertide.plans.domain import STRENGTH, STRENGTH_SQL, WINS, L, O, R, S, T, dealt, high_risk, labels, letters, load, outcomes, snapshots, transfers
from ledgertide.plans.registry import query

WON = "outcome_type IN ('full_freeze', 'partial_freeze', 'returned')"
BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY letter_id ORDER BY {STRENGTH_SQL}, observed_at DESC, seq) AS place FROM outcomes) WHERE place = 1)"


@query("a5_edge_rollup", f"""WITH {T} SELECT src, dst, chain, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS n, min(block_time) AS first_time, max(block_time) AS last_time,
  arg_max(token, (usd, -token)) AS top_token FROM t GROUP BY src, dst, chain""")
def a5(spark, sf):
    return A.edge_rollup(transfers(spark, sf))


@query("a1_total_drained", f"WITH {T} SELECT CAST(sum(usd) AS DOUBLE) AS usd_or_null, CAST(coalesce(sum(usd), 0) AS DOUBLE) AS usd, count(*) AS n_events FROM t WHERE src % 97 = 5")
def a1(spark, sf):
    return A.total_drained(transfers(spark, sf), F.col("src") % 97 == 5)


@query("a2_theft_events", f"WITH {T} SELECT src, count(*) AS n FROM t WHERE usd > 90000 GROUP BY src")
def a2(spark, sf):
    return transfers(spark, sf).where("usd > 90000").groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("a3_exchange_endpoints", f"""WITH {T}, {L} SELECT dst, min(name) AS name, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS n, min(block_time) AS first_time, max(block_time) AS last_time,
  count(DISTINCT tx_hash) AS n_tx FROM t JOIN labels ON dst = address WHERE category = 'exchange' GROUP BY dst""")
def a3(spark, sf):
    exchanges = labels(spark, sf).where("category = 'exchange'").selectExpr("address AS dst", "name")
    return A.labelled_endpoints(transfers(spark, sf).join(exchanges, "dst"))


@query("a4_unlabeled_counterparties", f"""WITH {T}, {L} SELECT dst, min(block_time) AS first_time, count(*) AS n FROM t WHERE dst NOT IN (SELECT address FROM labels) GROUP BY dst""")
def a4(spark, sf):
    known = labels(spark, sf).select(F.col("address").alias("dst"))
    return transfers(spark, sf).join(known, "dst", "left_anti").groupBy("dst").agg(F.min("block_time").alias("first_time"), F.count(F.lit(1)).alias("n"))


@query("a5_node_rollup", f"""WITH {T}, legs AS (SELECT src AS node, false AS inbound, usd FROM t UNION ALL SELECT dst, true, usd FROM t)
  SELECT node, CAST(coalesce(sum(usd) FILTER (WHERE inbound), 0) AS DOUBLE) AS usd_in, CAST(coalesce(sum(usd) FILTER (WHERE NOT inbound), 0) AS DOUBLE) AS usd_out, count(*) AS n_legs FROM legs GROUP BY node""")
def a5_nodes(spark, sf):
    return A.node_rollup(transfers(spark, sf))


@query("a6_counterparty_expansion", f"""WITH {T}, p AS (SELECT src, dst, sum(usd) AS total, count(*) AS n, count(DISTINCT token) AS n_tokens, min(block_time) AS first_time, max(block_time) AS last_time FROM t GROUP BY src, dst),
  r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY total DESC, n DESC, dst) AS place, count(*) OVER (PARTITION BY src) AS c FROM p)
  SELECT src, dst, CAST(total AS DOUBLE) AS usd, n, n_tokens, first_time, last_time, place, greatest(c - 5, 0) AS n_cut FROM r WHERE place <= 5""")
def a6(spark, sf):
    return A.counterparty_expansion(transfers(spark, sf), 5)


@query("a7_stolen_asset_totals", f"WITH {T} SELECT chain, case_id, CAST(sum(usd) AS DOUBLE) AS usd, count(*) AS n FROM t GROUP BY GROUPING SETS ((chain), (case_id), ())")
def a7(spark, sf):
    return A.grouped_totals(transfers(spark, sf), ["chain", "case_id"])


@query("a8_perp_hub", f"""WITH {T}, p AS (SELECT src, dst, sum(usd) AS total, min(block_time) AS first_time FROM t GROUP BY src, dst)
  SELECT src, arg_max(dst, (total, -dst)) AS hub, CAST(max(total) AS DOUBLE) AS usd FROM p GROUP BY src""")
def a8(spark, sf):
    pairs = transfers(spark, sf).groupBy("src", "dst").agg(F.sum("usd").alias("total"))
    return pairs.groupBy("src").agg(F.max_by("dst", F.struct("total", -F.col("dst"))).alias("hub"), A.money(F.max("total")).alias("usd"))


@query("a9_destinations", f"""WITH {T}, {L}, d AS (SELECT dst, sum(usd) AS total, count(*) AS n FROM t GROUP BY dst HAVING sum(usd) >= 100000)
  SELECT coalesce(d.dst, l.address) AS address, CAST(coalesce(total, 0) AS DOUBLE) AS usd, coalesce(n, 0) AS n,
  CASE WHEN category IS NULL THEN 'unknown' WHEN category = 'exchange' THEN 'cash_out' WHEN category IN ('mixer', 'bridge') THEN 'obfuscation' ELSE 'service' END AS role
  FROM d FULL JOIN labels l ON d.dst = l.address""")
def a9(spark, sf):
    flows = transfers(spark, sf).groupBy("dst").agg(F.sum("usd").alias("total"), F.count(F.lit(1)).alias("n")).where("total >= 100000")
    role = F.when(F.col("category").isNull(), "unknown").when(F.col("category") == "exchange", "cash_out").when(F.col("category").isin("mixer", "bridge"), "obfuscation").otherwise("service")
    joined = flows.join(labels(spark, sf), F.col("dst") == F.col("address"), "full")
    return joined.select(F.coalesce("dst", "address").alias("address"), A.money(F.coalesce("total", F.lit(0))).alias("usd"), F.coalesce("n", F.lit(0)).alias("n"), role.alias("role"))


@query("a11_pass2_candidates", f"""WITH {T}, s AS (SELECT dst, sum(CASE WHEN src % 97 = 5 THEN usd END) AS seeded, sum(usd) AS gross FROM t GROUP BY dst),
  b AS (SELECT s_suppkey AS dst, CAST(s_acctbal AS DECIMAL(12,2)) AS balance FROM supplier)
  SELECT dst, CAST(coalesce(seeded, gross) AS DOUBLE) AS inflow, CAST(balance AS DOUBLE) AS balance FROM s JOIN b USING (dst) WHERE balance >= 1000 AND balance * 2000 >= coalesce(seeded, gross)""")
def a11(spark, sf):
    flows = transfers(spark, sf).groupBy("dst").agg(F.sum(F.when(F.col("src") % 97 == 5, F.col("usd"))).alias("seeded"), F.sum("usd").alias("gross"))
    held = load(spark, sf, "supplier").selectExpr("s_suppkey AS dst", "CAST(s_acctbal AS DECIMAL(12,2)) AS balance")
    inflow = F.coalesce("seeded", "gross")
    return flows.join(held, "dst").where((F.col("balance") >= 1000) & (F.col("balance") * 2000 >= inflow)).select("dst", A.money(inflow).alias("inflow"), A.money(F.col("balance")).alias("balance"))


@query("a12_pivot_hub", f"""WITH {T}, {L}, p AS (SELECT case_id, dst, sum(usd) AS total, min(log_index) AS depth FROM t WHERE dst NOT IN (SELECT address FROM labels WHERE category = 'exchange') GROUP BY case_id, dst)
  SELECT case_id, arg_min(dst, (depth, -total, dst)) AS hub FROM p GROUP BY case_id""")
def a12(spark, sf):
    service = labels(spark, sf).where("category = 'exchange'").select(F.col("address").alias("dst"))
    per = transfers(spark, sf).join(service, "dst", "left_anti").groupBy("case_id", "dst").agg(F.sum("usd").alias("total"), F.min("log_index").alias("depth"))
    return per.groupBy("case_id").agg(F.min_by("dst", F.struct("depth", -F.col("total"), "dst")).alias("hub"))


@query("a13_exposure_summary", f"""WITH {T}, {L} SELECT category, CAST(sum(usd) AS DOUBLE) AS usd, count(DISTINCT dst) AS n_addresses,
  round(CAST(sum(usd) AS DOUBLE) / CAST((SELECT sum(usd) FROM t) AS DOUBLE) * 100, 6) AS pct FROM t JOIN labels ON dst = address GROUP BY category""")
def a13(spark, sf):
    flows = transfers(spark, sf)
    whole = flows.agg(A.money(F.sum("usd")).alias("whole"))
    known = labels(spark, sf).selectExpr("address AS dst", "category")
    per = flows.groupBy("dst").agg(F.sum("usd").alias("usd")).join(known, "dst").groupBy("category").agg(A.money(F.sum("usd")).alias("usd"), F.count(F.lit(1)).alias("n_addresses"))
    return per.crossJoin(F.broadcast(whole)).select("category", "usd", "n_addresses", F.round(F.col("usd") / F.col("whole") * 100, 6).alias("pct"))


@query("a14_attribution_coverage", f"""WITH {T}, {L}, p AS (SELECT dst, sum(usd) AS usd, count(*) AS n, dst IN (SELECT address FROM labels) AS known FROM t GROUP BY dst),
  s AS (SELECT coalesce(sum(usd) FILTER (WHERE known), 0) AS lu, sum(usd) AS u, coalesce(sum(n) FILTER (WHERE known), 0) AS ln, sum(n) AS n FROM p)
  SELECT CAST(lu AS DOUBLE) AS labelled_usd, CAST(u AS DOUBLE) AS usd, CAST(ln AS BIGINT) AS labelled_n, CAST(n AS BIGINT) AS n,
  round(CAST(lu AS DOUBLE) / CAST(u AS DOUBLE) * 100, 6) AS pct_usd, round(CAST(ln AS DOUBLE) / CAST(n AS DOUBLE) * 100, 6) AS pct_n FROM s""")
def a14(spark, sf):
    return A.attribution_coverage(transfers(spark, sf), labels(spark, sf))


@query("a15_endpoint_diversity", f"""WITH {T}, i AS (SELECT dst AS node, count(DISTINCT src) AS n_in FROM t GROUP BY dst), o AS (SELECT src AS node, count(DISTINCT dst) AS n_out FROM t GROUP BY src)
  SELECT node, n_in, n_out, n_in >= 30 AND n_out >= 30 AS is_infra FROM i JOIN o USING (node)""")
def a15(spark, sf):
    return A.endpoint_diversity(transfers(spark, sf), 30)


@query("a16_dust_fan_out", f"""WITH {T}, p AS (SELECT src, count(DISTINCT CASE WHEN usd < 60000 THEN dst END) AS n_dust, count(DISTINCT CASE WHEN usd >= 60000 THEN dst END) AS n_other FROM t GROUP BY src)
  SELECT * FROM p WHERE n_dust >= 10 AND n_dust >= 2 * n_other""")
def a16(spark, sf):
    return A.dust_fan_out(transfers(spark, sf), 60000, 10, 2)


EXPOSURES = "x AS (SELECT t.src AS address, t.dst AS counterparty, 'out' AS direction, severity, usd FROM t JOIN high_risk r ON t.dst = r.address UNION ALL SELECT t.dst, t.src, 'in', severity, usd FROM t JOIN high_risk r ON t.src = r.address)"


@query("a17_direct_risk", f"""WITH {T}, {R}, {EXPOSURES}, p AS (SELECT address, counterparty, direction, severity, sum(usd) AS usd, count(*) FILTER (WHERE usd >= 1) AS n FROM x GROUP BY ALL),
  s AS (SELECT address, CAST(sum(severity * least(n, 5)) AS BIGINT) AS score, CAST(sum(usd) AS DOUBLE) AS usd, count(DISTINCT counterparty) AS n_risky, bool_or(severity = 3) AS any_severe FROM p GROUP BY address)
  SELECT *, CASE WHEN any_severe OR score >= 20 THEN 'high' WHEN score >= 6 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS verdict FROM s""")
def a17(spark, sf):
    from ledgertide.operators.joins import two_sided_exposure

    return A.direct_risk(two_sided_exposure(transfers(spark, sf), high_risk(spark, sf)))


@query("a18_screening", f"""WITH {T}, {L}, {R}, c AS (SELECT dst, count(DISTINCT case_id) AS n_cases FROM t GROUP BY dst)
  SELECT s_suppkey AS address, category, risk_category, coalesce(n_cases, 0) AS n_cases,
  CASE WHEN risk_category = 'ofac_sanctioned' THEN 100 WHEN risk_category IS NOT NULL THEN 80 WHEN category = 'mixer' THEN 60 WHEN coalesce(n_cases, 0) >= 5 THEN 40 WHEN category IS NULL THEN 20 ELSE 5 END AS score
  FROM supplier LEFT JOIN labels l ON s_suppkey = l.address LEFT JOIN high_risk r ON s_suppkey = r.address LEFT JOIN c ON s_suppkey = c.dst""")
def a18(spark, sf):
    seen = transfers(spark, sf).groupBy(F.col("dst").alias("address")).agg(F.count_distinct("case_id").alias("n_cases"))
    asked = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("address"))
    joined = asked.join(labels(spark, sf).select("address", "category"), "address", "left").join(high_risk(spark, sf).select("address", "risk_category"), "address", "left").join(seen, "address", "left")
    n = F.coalesce("n_cases", F.lit(0))
    score = F.when(F.col("risk_category") == "ofac_sanctioned", 100).when(F.col("risk_category").isNotNull(), 80).when(F.col("category") == "mixer", 60).when(n >= 5, 40).when(F.col("category").isNull(), 20).otherwise(5)
    return joined.select("address", "category", "risk_category", n.alias("n_cases"), score.alias("score"))


@query("a19_exposure_probe", f"""WITH {T}, {R} SELECT t.src AS address, risk_category, CAST(sum(usd) AS DOUBLE) AS usd, count(DISTINCT t.dst) AS n FROM t JOIN high_risk r ON t.dst = r.address
  WHERE block_time >= TIMESTAMP '1999-01-01' GROUP BY t.src, risk_category""")
def a19(spark, sf):
    risky = high_risk(spark, sf).selectExpr("address AS dst", "risk_category")
    recent = transfers(spark, sf).where("block_time >= TIMESTAMP_NTZ '1999-01-01 00:00:00'").join(risky, "dst")
    return recent.groupBy(F.col("src").alias("address"), "risk_category").agg(A.money(F.sum("usd")).alias("usd"), F.count_distinct("dst").alias("n"))


@query("a20_token_risk", """SELECT p_brand, count(*) FILTER (WHERE p_size > 40) AS severe, count(*) FILTER (WHERE p_size BETWEEN 20 AND 40) AS warned,
  CASE WHEN count(*) FILTER (WHERE p_size > 40) >= 20 THEN 'critical' WHEN count(*) FILTER (WHERE p_size > 40) > 0 THEN 'elevated' ELSE 'ok' END AS verdict FROM part GROUP BY p_brand""")
def a20(spark, sf):
    severe, warned = F.count_if(F.col("p_size") > 40), F.count_if(F.col("p_size").between(20, 40))
    return load(spark, sf, "part").groupBy("p_brand").agg(severe.alias("severe"), warned.alias("warned"), F.when(severe >= 20, "critical").when(severe > 0, "elevated").otherwise("ok").alias("verdict"))


@query("a21_issuer_priors", f"""WITH {O}, {BEST}, j AS (SELECT issuer, tier, outcome_type, CAST(date_sub('hour', sent_at, observed_at) AS DOUBLE) AS h FROM best JOIN letters USING (letter_id))
  SELECT issuer, tier, count(*) AS n, count(*) FILTER (WHERE {WON}) AS wins, round((count(*) FILTER (WHERE {WON}) + 1.0) / (count(*) + 2.0), 9) AS posterior, round(avg(h), 6) AS mean_hours, median(h) AS median_hours FROM j GROUP BY issuer, tier""")
def a21(spark, sf):
    return A.issuer_priors(letters(spark, sf), A.strongest_outcome(outcomes(spark, sf), STRENGTH), WINS)


@query("a22_trimmed_statistics", """WITH p AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place FROM events),
  k AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE greatest(n // 10, 1) END AS cut FROM p)
  SELECT event_type, n, round(avg(value), 6) AS trimmed_mean, round(median(value), 6) AS trimmed_median FROM k WHERE place > cut AND place <= n - cut GROUP BY event_type, n""")
def a22(spark, sf):
    return A.trimmed(load(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", 5)


@query("a24_cooperation_profiles", f"""WITH {O} SELECT issuer, count(DISTINCT letter_id) AS n_letters, count(outcome_type) AS n_outcomes, count(*) FILTER (WHERE outcome_type = 'declined') AS n_declined,
  CAST(coalesce(sum(coalesce(returned_usd, frozen_usd)), 0) AS DOUBLE) AS recovered, round(CAST(count(*) FILTER (WHERE {WON}) AS DOUBLE) / greatest(count(outcome_type), 1), 9) AS win_rate
  FROM letters LEFT JOIN outcomes USING (letter_id) GROUP BY issuer""")
def a24(spark, sf):
    joined = letters(spark, sf).join(outcomes(spark, sf), "letter_id", "left")
    n = F.count("outcome_type")
    won = F.count_if(F.col("outcome_type").isin(*WINS))
    return joined.groupBy("issuer").agg(F.count_distinct("letter_id").alias("n_letters"), n.alias("n_outcomes"), F.count_if(F.col("outcome_type") == "declined").alias("n_declined"), A.money(F.coalesce(F.sum(F.coalesce("returned_usd", "frozen_usd")), F.lit(0))).alias("recovered"), F.round(won / F.greatest(n, F.lit(1)), 9).alias("win_rate"))


@query("a25_instrument", f"""WITH {O}, p AS (SELECT issuer, tier, count(outcome_type) AS n, count(*) FILTER (WHERE {WON}) AS w, count(*) FILTER (WHERE outcome_type = 'declined') AS d FROM letters LEFT JOIN outcomes USING (letter_id) GROUP BY issuer, tier)
  SELECT issuer, tier, CASE WHEN n = 0 THEN 'letter' WHEN 2 * w >= n THEN 'letter' WHEN 3 * d >= n THEN 'subpoena' ELSE 'court_order' END AS instrument FROM p""")
def a25(spark, sf):
    per = letters(spark, sf).join(outcomes(spark, sf), "letter_id", "left").groupBy("issuer", "tier").agg(F.count("outcome_type").alias("n"), F.count_if(F.col("outcome_type").isin(*WINS)).alias("w"), F.count_if(F.col("outcome_type") == "declined").alias("d"))
    return per.select("issuer", "tier", F.expr("CASE WHEN n = 0 THEN 'letter' WHEN 2 * w >= n THEN 'letter' WHEN 3 * d >= n THEN 'subpoena' ELSE 'court_order' END").alias("instrument"))


@query("a26_wilson", f"""WITH {O}, p AS (SELECT issuer, count(outcome_type) AS n, count(*) FILTER (WHERE {WON}) AS wins FROM letters LEFT JOIN outcomes USING (letter_id) GROUP BY issuer),
  q AS (SELECT *, wins / n AS p, 1.96 * 1.96 AS zz FROM p)
  SELECT issuer, n, wins, round(CASE WHEN n > 0 THEN greatest((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 0) ELSE 0 END, 9) AS low,
  round(CASE WHEN n > 0 THEN least((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 1) ELSE 1 END, 9) AS high FROM q""")
def a26(spark, sf):
    return A.win_interval(letters(spark, sf).join(outcomes(spark, sf), "letter_id", "left"), WINS)


@query("a27_recovery_statistics", f"""WITH {O}, {BEST}, c AS (SELECT case_id, count(*) AS n, max(CASE WHEN outcome_type = 'full_freeze' THEN 2 WHEN {WON} THEN 1 ELSE 0 END) AS best FROM letters LEFT JOIN best USING (letter_id) GROUP BY case_id)
  SELECT CASE best WHEN 2 THEN 'full' WHEN 1 THEN 'partial' ELSE 'zero' END AS result, count(*) AS n_cases, median(n) AS median_letters FROM c GROUP BY ALL""")
def a27(spark, sf):
    best = A.strongest_outcome(outcomes(spark, sf), STRENGTH)
    rank = F.when(F.col("outcome_type") == "full_freeze", 2).when(F.col("outcome_type").isin(*WINS), 1).otherwise(0)
    cases = letters(spark, sf).join(best, "letter_id", "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    return cases.groupBy(F.expr("CASE best WHEN 2 THEN 'full' WHEN 1 THEN 'partial' ELSE 'zero' END").alias("result")).agg(F.count(F.lit(1)).alias("n_cases"), F.median("n").alias("median_letters"))


@query("a28_expected_recovery", f"""WITH {O}, p AS (SELECT issuer, (count(*) FILTER (WHERE {WON}) + 1) / (count(*) + 2) AS prior FROM letters JOIN outcomes USING (letter_id) GROUP BY issuer)
  SELECT case_id, round(sum(CAST(requested_usd AS DOUBLE) * prior * CASE tier WHEN 'F' THEN 0.9 WHEN 'P' THEN 0.6 ELSE 0.4 END), 2) AS expected, CAST(sum(requested_usd) AS DOUBLE) AS requested
  FROM letters JOIN p USING (issuer) GROUP BY case_id""")
def a28(spark, sf):
    sent = letters(spark, sf)
    won = F.count_if(F.col("outcome_type").isin(*WINS))
    prior = sent.join(outcomes(spark, sf), "letter_id").groupBy("issuer").agg(((won + 1) / (F.count(F.lit(1)) + 2)).alias("prior"))
    weight = F.expr("CASE tier WHEN 'F' THEN 0.9D WHEN 'P' THEN 0.6D ELSE 0.4D END")
    return sent.join(prior, "issuer").groupBy("case_id").agg(F.round(F.sum(F.col("requested_usd").cast("double") * F.col("prior") * weight), 2).alias("expected"), A.money(F.sum("requested_usd")).alias("requested"))


@query("a29_firm_volume", f"""WITH {O}, {BEST}, c AS (SELECT issuer, case_id, bool_or({WON}) AS won, sum(coalesce(frozen_usd, returned_usd, 0)) AS usd, count(*) AS n FROM letters LEFT JOIN best USING (letter_id) GROUP BY issuer, case_id)
  SELECT issuer, count(*) AS n_cases, count(*) FILTER (WHERE won) AS n_won, CAST(sum(usd) AS DOUBLE) AS usd, CAST(sum(n) AS BIGINT) AS n_letters FROM c GROUP BY issuer""")
def a29(spark, sf):
    best = A.strongest_outcome(outcomes(spark, sf), STRENGTH)
    cases = letters(spark, sf).join(best, "letter_id", "left").groupBy("issuer", "case_id").agg(F.bool_or(F.col("outcome_type").isin(*WINS)).alias("won"), F.sum(F.coalesce("frozen_usd", "returned_usd", F.lit(0))).alias("usd"), F.count(F.lit(1)).alias("n"))
    return cases.groupBy("issuer").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("won").alias("n_won"), A.money(F.sum("usd")).alias("usd"), F.sum("n").alias("n_letters"))


@query("a30_throughput_medians", f"""WITH {O}, f AS (SELECT letter_id, issuer, sent_at, min(observed_at) AS first_reply FROM letters JOIN outcomes USING (letter_id) GROUP BY ALL)
  SELECT issuer, median(CAST(date_sub('hour', sent_at, first_reply) AS DOUBLE)) AS median_hours, max(first_reply) AS last_reply FROM f GROUP BY issuer""")
def a30(spark, sf):
    first = letters(spark, sf).join(outcomes(spark, sf), "letter_id").groupBy("letter_id", "issuer", "sent_at").agg(F.min("observed_at").alias("first_reply"))
    return first.groupBy("issuer").agg(F.median(F.expr("timestampdiff(HOUR, sent_at, first_reply)").cast("double")).alias("median_hours"), F.max("first_reply").alias("last_reply"))


@query("a31_top_issuers", f"""WITH {O}, {BEST} SELECT issuer, count(*) AS n, CAST(sum(coalesce(frozen_usd, 0)) AS DOUBLE) AS usd FROM letters JOIN best USING (letter_id) GROUP BY issuer ORDER BY n DESC, issuer LIMIT 5""")
def a31(spark, sf):
    best = A.strongest_outcome(outcomes(spark, sf), STRENGTH)
    return letters(spark, sf).join(best, "letter_id").groupBy("issuer").agg(F.count(F.lit(1)).alias("n"), A.money(F.sum(F.coalesce("frozen_usd", F.lit(0)))).alias("usd")).orderBy(F.desc("n"), "issuer").limit(5)


@query("a32_watchlist_overview", f"""WITH {S} SELECT event_type, tx_count % 3 AS priority, count(*) AS n, CAST(sum(usd_value) AS DOUBLE) AS usd FROM snapshots GROUP BY GROUPING SETS ((event_type), (tx_count % 3), ())""")
def a32(spark, sf):
    rows = snapshots(spark, sf).withColumn("priority", F.col("tx_count") % 3).withColumnRenamed("usd_value", "usd")
    return A.grouped_totals(rows, ["event_type", "priority"])


@query("a33_dashboard_summary", f"""WITH {S}, m AS (SELECT max(taken_at) AS now FROM snapshots) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE taken_at > now - INTERVAL 1 DAY) AS last_day,
  count(*) FILTER (WHERE taken_at > now - INTERVAL 7 DAY) AS last_week, count(*) FILTER (WHERE abs(usd_value) >= 100) AS large FROM snapshots, m GROUP BY event_type""")
def a33(spark, sf):
    rows = snapshots(spark, sf)
    now = rows.agg(F.max("taken_at").alias("now"))
    joined = rows.crossJoin(F.broadcast(now))
    since = lambda days: F.count_if(F.col("taken_at") > F.col("now") - F.expr(f"INTERVAL {days} DAY"))
    return joined.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), since(1).alias("last_day"), since(7).alias("last_week"), F.count_if(F.abs("usd_value") >= 100).alias("large"))


@query("a34_mail_summary", f"""WITH {S} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE tx_count < 80) AS sent, count(*) FILTER (WHERE tx_count >= 80) AS failed, max(taken_at) AS latest FROM snapshots GROUP BY event_type""")
def a34(spark, sf):
    return snapshots(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tx_count") < 80).alias("sent"), F.count_if(F.col("tx_count") >= 80).alias("failed"), F.max("taken_at").alias("latest"))


@query("a35_cluster_rollup", f"""WITH {T}, m AS (SELECT dst % 10 AS cluster, src AS a, usd FROM t UNION ALL SELECT dst % 10, dst, 0 FROM t)
  SELECT cluster, count(DISTINCT a) AS n_members, CAST(sum(usd) AS DOUBLE) AS usd, CAST(list_min(list(a)) AS BIGINT) AS first_member FROM m GROUP BY cluster""")
def a35(spark, sf):
    legs = transfers(spark, sf).select((F.col("dst") % 10).alias("cluster"), F.explode(F.array(F.struct(F.col("src").alias("a"), "usd"), F.struct(F.col("dst").alias("a"), F.lit(0).cast("decimal(18,4)").alias("usd")))).alias("leg"))
    return legs.groupBy("cluster").agg(F.count_distinct("leg.a").alias("n_members"), A.money(F.sum("leg.usd")).alias("usd"), F.min("leg.a").alias("first_member"))


@query("a36_class_action", f"""WITH {T}, p AS (SELECT DISTINCT case_id, dst FROM t WHERE usd > 10), k AS (SELECT dst FROM p GROUP BY dst HAVING count(*) <= 50), s AS (SELECT a.case_id AS x, b.case_id AS y, count(*) AS shared FROM p a JOIN p b ON a.dst = b.dst AND a.case_id < b.case_id JOIN k ON a.dst = k.dst GROUP BY ALL)
  SELECT x, y, shared FROM s WHERE shared >= 2""")
def a36(spark, sf):
    """Addresses of more than 50 cases are infrastructure and link none of them."""
    pairs = transfers(spark, sf).where("usd > 10").select("case_id", "dst").distinct()
    few = pairs.groupBy("dst").count().where("count <= 50").select("dst")
    pairs = pairs.join(few, "dst", "left_semi")
    both = pairs.withColumnRenamed("case_id", "x").join(pairs.withColumnRenamed("case_id", "y"), "dst").where("x < y")
    return both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@query("a37_internal_blacklist", f"""WITH {T}, {L} SELECT t.dst, chain, count(DISTINCT case_id) AS n_cases, bool_or(usd > 90000) AND NOT bool_or(coalesce(category, '') = 'exchange') AS armed, arg_max(case_id, (usd, case_id)) AS top_case
  FROM t LEFT JOIN labels ON t.dst = address GROUP BY t.dst, chain""")
def a37(spark, sf):
    known = labels(spark, sf).selectExpr("address AS dst", "category")
    joined = transfers(spark, sf).join(known, "dst", "left")
    return joined.groupBy("dst", "chain").agg(F.count_distinct("case_id").alias("n_cases"), (F.bool_or(F.col("usd") > 90000) & ~F.bool_or(F.coalesce("category", F.lit("")) == "exchange")).alias("armed"), F.max_by("case_id", F.struct("usd", "case_id")).alias("top_case"))


@query("a38_observations", f"""WITH {T}, {R} SELECT t.dst AS address, chain, case_id, CAST(sum(usd) AS DOUBLE) AS usd, bool_or(coalesce(risk_category = 'ofac_sanctioned', false)) AS is_ofac, max(block_time) AS observed_at
  FROM t LEFT JOIN high_risk r ON t.dst = r.address GROUP BY t.dst, chain, case_id""")
def a38(spark, sf):
    risky = high_risk(spark, sf).selectExpr("address AS dst", "risk_category")
    joined = transfers(spark, sf).join(risky, "dst", "left")
    return joined.groupBy(F.col("dst").alias("address"), "chain", "case_id").agg(A.money(F.sum("usd")).alias("usd"), F.bool_or(F.coalesce(F.col("risk_category") == "ofac_sanctioned", F.lit(False))).alias("is_ofac"), F.max("block_time").alias("observed_at"))


@query("a39_per_asset", f"WITH {T} SELECT token, CAST(sum(usd) AS DOUBLE) AS usd, CAST(sum(amt) AS DOUBLE) AS amount, count(*) AS n FROM t GROUP BY token")
def a39(spark, sf):
    return transfers(spark, sf).groupBy("token").agg(A.money(F.sum("usd")).alias("usd"), A.money(F.sum("amt")).alias("amount"), F.count(F.lit(1)).alias("n"))


@query("a40_digest", """WITH d AS (SELECT *, sha256(event_type || '|' || props) AS h FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ts, event_id) AS place FROM d)
  SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 100) AS severe FROM k WHERE place = 1 GROUP BY event_type""")
def a40(spark, sf):
    rows = load(spark, sf, "events").withColumn("h", F.sha2(F.concat_ws("|", "event_type", "props").cast("binary"), 256))
    first = rows.groupBy("h").agg(F.min_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("first"))
    return first.groupBy("first.event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first.value") >= 100).alias("severe"))


@query("a41_correlation_stats", f"WITH {T} SELECT chain, count(*) AS n, count(DISTINCT dst) AS n_addresses, count(DISTINCT case_id) AS n_cases, count(*) FILTER (WHERE usd > 50000) AS n_large FROM t GROUP BY chain")
def a41(spark, sf):
    return transfers(spark, sf).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("n_addresses"), F.count_distinct("case_id").alias("n_cases"), F.count_if(F.col("usd") > 50000).alias("n_large"))


@query("a42_nft_batches", """WITH b AS (SELECT l_orderkey AS tx, l_suppkey AS dst, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY ALL),
  e AS (SELECT DISTINCT tx, dst, unnest(ids) AS token_id FROM b) SELECT dst, count(*) AS n, count(DISTINCT token_id) AS n_tokens FROM e GROUP BY dst""")
def a42(spark, sf):
    lines = load(spark, sf, "lineitem")
    lines = dealt(lines, "l_orderkey", lines.count())
    batches = lines.groupBy(F.col("l_orderkey").alias("tx"), F.col("l_suppkey").alias("dst")).agg(F.collect_list("l_partkey").alias("ids"))
    return batches.select("tx", "dst", F.explode("ids").alias("token_id")).dropDuplicates().groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token_id").alias("n_tokens"))


@query("a43_precision_recall", f"""WITH {T}, reached AS (SELECT DISTINCT case_id, dst FROM t WHERE usd > 90000), expected AS (SELECT DISTINCT case_id, dst FROM t WHERE amt > 48),
  j AS (SELECT coalesce(r.case_id, e.case_id) AS case_id, r.dst IS NOT NULL AS got, e.dst IS NOT NULL AS want FROM reached r FULL JOIN expected e ON r.case_id = e.case_id AND r.dst = e.dst)
  SELECT case_id, count(*) FILTER (WHERE got AND want) AS hits, round(CAST(count(*) FILTER (WHERE got AND want) AS DOUBLE) / greatest(count(*) FILTER (WHERE want), 1), 9) AS recall,
  round(CAST(count(*) FILTER (WHERE got AND want) AS DOUBLE) / greatest(count(*) FILTER (WHERE got), 1), 9) AS precision FROM j GROUP BY case_id""")
def a43(spark, sf):
    # one pass: which of the two conditions any transfer of the pair meets
    pairs = transfers(spark, sf).groupBy("case_id", "dst").agg(F.bool_or(F.col("usd") > 90000).alias("got"), F.bool_or(F.col("amt") > 48).alias("want"))
    hits = F.count_if(F.col("got") & F.col("want"))
    out = pairs.where("got OR want").groupBy("case_id").agg(hits.alias("hits"), F.round(hits / F.greatest(F.count_if("want"), F.lit(1)), 9).alias("recall"), F.round(hits / F.greatest(F.count_if("got"), F.lit(1)), 9).alias("precision"))
    return out


@query("a44_usage_metering", f"""WITH {S}, o AS (SELECT watch_id, min(taken_at) + INTERVAL 10 DAY AS period_start FROM snapshots GROUP BY watch_id)
  SELECT o.watch_id, CAST(coalesce(sum(tx_count) FILTER (WHERE taken_at >= period_start AND event_type = 'purchase'), 0) AS BIGINT) AS used FROM o LEFT JOIN snapshots USING (watch_id) GROUP BY o.watch_id""")
def a44(spark, sf):
    rows = snapshots(spark, sf).withColumn("period_start", F.min("taken_at").over(Window.partitionBy("watch_id")) + F.expr("INTERVAL 10 DAY"))
    return rows.groupBy("watch_id").agg(F.coalesce(F.sum(F.when((F.col("taken_at") >= F.col("period_start")) & (F.col("event_type") == "purchase"), F.col("tx_count"))), F.lit(0)).alias("used"))
