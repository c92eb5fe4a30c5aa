"""Loops over edges (G) over the mapped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.operators import graph as G
from ledgertide.operators.aggregates import money
from ledgertide.operators.joins import next_spend, swap_outputs
from ledgertide.operators.subsets import input_subsets
from ledgertide.plans.domain import L, R, T, dealt, high_risk, labels, load, transfers
from ledgertide.plans.registry import query

#: Transfers of less are dust and make no edge.
FLOOR = 10
E = "e AS (SELECT DISTINCT src, dst FROM t WHERE usd > {0})"


def _edges(spark, sf, least):
    return transfers(spark, sf).where(f"usd > {least}").select("src", "dst").distinct()


def _seeds(spark, sf, condition):
    return load(spark, sf, "supplier").where(condition).select(F.col("s_suppkey").alias("node"))


def reach_sql(seeds: str, depth: int, more: str = "") -> str:
    return f"r AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE {seeds} UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < {depth}{more})"


@query("g1_trace", f"WITH RECURSIVE {T}, {E.format(FLOOR)}, {reach_sql('s_suppkey % 17 = 0', 4)} SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def g1(spark, sf):
    return G.bfs(_edges(spark, sf, FLOOR), _seeds(spark, sf, "s_suppkey % 17 = 0"), 4)


@query("g2_one_hop_expansion", f"WITH {T}, c AS (SELECT src, count(*) AS n_out FROM t GROUP BY src) SELECT src, dst, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd, any_value(n_out) > 60 AS is_service FROM t JOIN c USING (src) GROUP BY src, dst")
def g2(spark, sf):
    out = transfers(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"))
    service = out.groupBy("src").agg((F.sum("n") > 60).alias("is_service"))
    return out.join(service, "src").select("src", "dst", "n", "usd", "is_service")


@query("g3_service_cut", f"""WITH RECURSIVE {T}, {E.format(FLOOR)}, s AS (SELECT src FROM t GROUP BY src HAVING count(*) > 60),
  {reach_sql('s_suppkey % 5 = 0', 4, ' AND node NOT IN (SELECT src FROM s)')} SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def g3(spark, sf):
    service = transfers(spark, sf).groupBy(F.col("src").alias("node")).count().where("count > 60").select("node")
    return G.bfs(_edges(spark, sf, FLOOR), _seeds(spark, sf, "s_suppkey % 5 = 0"), 4, service)


@query("g4_traced_inbound", f"""WITH {T}, p AS (SELECT *, CASE WHEN token % 10 <> 0 THEN usd END AS price FROM t),
  a AS (SELECT dst, arg_max(tx_hash, (price, -tx_hash)) FILTER (WHERE price > 50) AS big, arg_max(tx_hash, (amt, -tx_hash)) FILTER (WHERE price IS NULL) AS unpriced, arg_max(tx_hash, (price, -tx_hash)) FILTER (WHERE price IS NOT NULL) AS any_priced FROM p GROUP BY dst)
  SELECT dst, coalesce(big, unpriced, any_priced) AS followed, unpriced AS also FROM a""")
def g4(spark, sf):
    priced = transfers(spark, sf).withColumn("price", F.when(F.col("token") % 10 != 0, F.col("usd")))
    key = lambda by, keep: F.max(F.when(keep, F.struct(F.col(by), (-F.col("tx_hash")).alias("t"))))
    found = priced.groupBy("dst").agg(key("price", F.col("price") > 50).alias("big"), key("amt", F.col("price").isNull()).alias("unpriced"), key("price", F.col("price").isNotNull()).alias("priced"))
    return found.select("dst", (-F.coalesce("big.t", "unpriced.t", "priced.t")).alias("followed"), (-F.col("unpriced.t")).alias("also"))


def frontier_sql(h: int) -> str:
    """CTEs of round h > 1: pairs, matches, splits, followed legs, arrivals, nodes so far."""
    each, out = "node, i_tx, i_log, i_token, i_src, i_time, i_usd", "node AS src, o_dst AS dst, o_tx AS tx, o_log AS log, o_token AS token, o_time AS time, o_symbol AS symbol, o_amt AS amt, o_usd AS usd"
    ppm = "CAST(floor(abs(CAST(o.{0} - i.{0} AS DOUBLE)) * 1000000 / CAST(i.{0} AS DOUBLE)) AS BIGINT)"
    return f"""i{h} AS (SELECT DISTINCT src, dst, tx, log, token, time, symbol, amt, usd FROM a{h - 1} WHERE dst IN (SELECT node FROM service)),
  p{h} AS (SELECT i.dst AS node, i.src AS i_src, i.tx AS i_tx, i.log AS i_log, i.token AS i_token, i.time AS i_time, i.usd AS i_usd, o.dst AS o_dst, o.tx AS o_tx, o.log AS o_log, o.token AS o_token, o.time AS o_time, o.symbol AS o_symbol, o.amt AS o_amt, o.usd AS o_usd,
    i.symbol = o.symbol AS same, CASE WHEN i.symbol = o.symbol THEN {ppm.format("amt")} ELSE {ppm.format("usd")} END AS ppm FROM i{h} i JOIN g o ON o.src = i.dst AND date_diff('day', i.time, o.time) BETWEEN 1 AND 30 AND i.tx <> o.tx),
  m{h} AS (SELECT * FROM p{h} WHERE ppm <= 20000 QUALIFY row_number() OVER (PARTITION BY {each} ORDER BY same DESC, ppm, o_time, o_tx, o_log, o_token, o_dst, o_usd) <= 3),
  x{h} AS (SELECT *, sum(o_usd) OVER (PARTITION BY {each} ORDER BY o_usd DESC, o_time, o_tx, o_log, o_token, o_dst ROWS UNBOUNDED PRECEDING) AS running FROM p{h} p WHERE o_usd <= i_usd
    AND NOT EXISTS (SELECT 1 FROM m{h} m WHERE m.node = p.node AND m.i_tx = p.i_tx AND m.i_log = p.i_log AND m.i_token = p.i_token AND m.i_src = p.i_src)),
  y{h} AS (SELECT *, count(*) OVER w AS legs, max(running) OVER w AS total FROM x{h} WHERE (running - o_usd) * 100 < i_usd * 90 WINDOW w AS (PARTITION BY {each})),
  f{h} AS (SELECT *, 'all' AS way FROM g WHERE src IN (SELECT dst FROM a{h - 1}) AND src NOT IN (SELECT node FROM service) UNION SELECT {out}, 'match' FROM m{h} UNION SELECT {out}, 'split' FROM y{h} WHERE legs BETWEEN 2 AND 8 AND total * 100 BETWEEN i_usd * 90 AND i_usd * 110),
  a{h} AS (SELECT * FROM f{h} WHERE dst NOT IN (SELECT node FROM v{h - 1})), v{h} AS (SELECT * FROM v{h - 1} UNION ALL SELECT dst, {h}, min(way) FROM a{h} GROUP BY dst)"""


@query("g5_value_frontier", f"""WITH {T}, g AS (SELECT DISTINCT src, dst, tx_hash AS tx, log_index AS log, token, block_time AS time, token % 5 AS symbol, amt, usd FROM t WHERE usd > 10), service AS (SELECT src AS node FROM t GROUP BY src HAVING count(*) > 30),
  v0 AS (SELECT DISTINCT s_suppkey AS node, 0 AS depth, 'seed' AS way FROM supplier WHERE s_suppkey = 2), a1 AS (SELECT *, 'all' AS way FROM g WHERE src IN (SELECT node FROM v0) AND dst NOT IN (SELECT node FROM v0)), v1 AS (SELECT * FROM v0 UNION ALL SELECT dst, 1, min(way) FROM a1 GROUP BY dst),
  {", ".join(frontier_sql(h) for h in (2, 3))} SELECT node, CAST(depth AS INTEGER) AS depth, way FROM v3""")
def g5(spark, sf):
    flows = transfers(spark, sf)
    legs = flows.where(f"usd > {FLOOR}").selectExpr("src", "dst", "tx_hash AS tx", "log_index AS log", "token", "block_time AS time", "token % 5 AS symbol", "amt", "usd").distinct()
    service = flows.groupBy(F.col("src").alias("node")).count().where("count > 30").select("node")
    return G.value_frontier(G.settle(legs), _seeds(spark, sf, "s_suppkey = 2"), G.settle(service), 3, 30, 2, 10, 8)


@query("g6_terminals", f"""WITH {T}, {L}, m AS (SELECT address, true AS labelled FROM labels) SELECT src, dst, token, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd, dst % 50 = 0 AS burn
  FROM t LEFT JOIN m ON dst = address WHERE coalesce(labelled, false) OR dst % 50 = 0 GROUP BY src, dst, token""")
def g6(spark, sf):
    known = labels(spark, sf).select(F.col("address").alias("dst"), F.lit(True).alias("labelled"))
    hits = transfers(spark, sf).join(known, "dst", "left").where("labelled OR dst % 50 = 0")
    return hits.groupBy("src", "dst", "token").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd")).withColumn("burn", F.col("dst") % 50 == 0)


CROSS = """e AS (SELECT DISTINCT chain || ':' || src AS src, chain || ':' || dst AS dst FROM t WHERE usd > 10
  UNION SELECT a.c || ':' || s_suppkey, b.c || ':' || s_suppkey FROM supplier, (VALUES ('A'), ('N'), ('R')) a(c), (VALUES ('A'), ('N'), ('R')) b(c) WHERE s_suppkey % 7 = 0 AND a.c <> b.c)"""


@query("g8_cross_chain", f"""WITH RECURSIVE {T}, {CROSS}, r AS (SELECT 'A:' || s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 5)
  SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def g8(spark, sf):
    at = lambda c, a: F.concat(F.col(c), F.lit(":"), F.col(a).cast("string"))
    same = transfers(spark, sf).where("usd > 10").select(at("chain", "src").alias("src"), at("chain", "dst").alias("dst")).distinct()
    chains = [(a, b) for a in "ANR" for b in "ANR" if a != b]
    bridge = load(spark, sf, "supplier").where("s_suppkey % 7 = 0").select(F.explode(F.array(*(F.struct(F.concat(F.lit(a + ":"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit(b + ":"), F.col("s_suppkey").cast("string")).alias("dst")) for a, b in chains))).alias("e")).select("e.*")
    seeds = load(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("A:"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.bfs(same.unionByName(bridge), seeds, 5)


def components_sql(links: str, name: str = "c") -> str:
    """CTEs name(node, component) over links(a, b)."""
    return f"""{name}_u AS (SELECT a, b FROM {links} WHERE a <> b UNION SELECT b, a FROM {links} WHERE a <> b), {name}_r(a, b) AS (SELECT a, b FROM {name}_u UNION SELECT r.a, u.b FROM {name}_r r JOIN {name}_u u ON r.b = u.a),
  {name} AS (SELECT a AS node, min(b) AS component FROM {name}_r GROUP BY a)"""


def pair_components_sql(links: str, name: str = "c") -> str:
    """The same over edges of few receivers: receivers that share a sender, or pay each other, are closed
    first (a small table), and senders join one of theirs."""
    return f"""{name}_d AS (SELECT DISTINCT x.b AS a, y.b AS b FROM {links} x JOIN {links} y ON x.a = y.a UNION SELECT a, b FROM {links} WHERE a IN (SELECT b FROM {links}) UNION SELECT b, a FROM {links} WHERE a IN (SELECT b FROM {links})),
  {name}_r(a, b) AS (SELECT a, b FROM {name}_d UNION SELECT r.a, d.b FROM {name}_r r JOIN {name}_d d ON r.b = d.a), {name}_t AS (SELECT a, min(b) AS root FROM {name}_r GROUP BY a),
  {name}_m AS (SELECT a AS node, root FROM {name}_t UNION SELECT l.a, t.root FROM {links} l JOIN {name}_t t ON l.b = t.a), {name}_w AS (SELECT root, min(node) AS component FROM {name}_m GROUP BY root), {name} AS (SELECT node, component FROM {name}_m JOIN {name}_w USING (root))"""


@query("g10_case_clusters", f"""WITH RECURSIVE {T}, legs AS (SELECT DISTINCT src, dst, block_time FROM t WHERE usd > 10), few AS (SELECT src FROM legs GROUP BY src HAVING count(DISTINCT dst) BETWEEN 2 AND 20),
  links AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM legs x JOIN legs y ON x.src = y.src AND x.dst < y.dst AND abs(date_diff('day', x.block_time, y.block_time)) <= 60 WHERE x.src IN (SELECT src FROM few)),
  {components_sql("links")} SELECT * FROM c""")
def g10(spark, sf):
    legs = transfers(spark, sf).where("usd > 10").select("src", "dst", "block_time").distinct()
    return G.components(G.group_links(legs, ["src"], "dst", "block_time", 60, 20))


@query("g11_evidence_clusters", f"""WITH RECURSIVE {T}, links AS (SELECT DISTINCT src AS a, dst AS b FROM t WHERE usd > 10), high AS (SELECT DISTINCT src AS a, dst AS b FROM t WHERE usd > 50000 AND chain = 'A'), {pair_components_sql("links")}, {pair_components_sql("high", "h")},
  m AS (SELECT c.component, c.node, coalesce(h.component, -c.node - 1) AS hc FROM c LEFT JOIN h ON c.node = h.node)
  SELECT component, count(*) AS n, 'cluster_' || substr(sha256(component || ':' || count(*) || ':' || CAST(sum(CAST('0x' || substr(md5(CAST(node AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT)), 1, 8) AS name,
  CASE WHEN count(DISTINCT hc) = 1 THEN 'high' ELSE 'medium' END AS confidence FROM m GROUP BY component""")
def g11(spark, sf):
    every = G.components(_edges(spark, sf, FLOOR).toDF("a", "b"))
    high = G.components(transfers(spark, sf).where("usd > 50000 AND chain = 'A'").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()).withColumnRenamed("component", "hc")
    joined = every.join(high, "node", "left").withColumn("hc", F.coalesce("hc", -F.col("node") - 1))
    piece = F.conv(F.substring(F.md5(F.col("node").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    rolled = joined.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(piece).alias("s"), F.min("hc").alias("lo"), F.max("hc").alias("hi"))
    name = F.concat(F.lit("cluster_"), F.substring(F.sha2(F.concat_ws(":", F.col("component").cast("string"), F.col("n").cast("string"), F.col("s").cast("string")).cast("binary"), 256), 1, 8))
    return rolled.select("component", "n", name.alias("name"), F.when(F.col("lo") == F.col("hi"), "high").otherwise("medium").alias("confidence"))


@query("g12_cluster_names", f"""WITH RECURSIVE {T}, {L}, links AS (SELECT DISTINCT src AS a, dst AS b FROM t WHERE usd > 10), {pair_components_sql("links")},
  o AS (SELECT component, t.dst, count(*) AS n FROM t JOIN c ON t.src = c.node GROUP BY ALL), p AS (SELECT o.* FROM o LEFT JOIN c ON o.dst = c.node AND o.component = c.component WHERE c.node IS NULL),
  q AS (SELECT component, name, category, row_number() OVER (PARTITION BY component ORDER BY CASE category WHEN 'exchange' THEN 3 WHEN 'bridge' THEN 1 WHEN 'defi' THEN 1 ELSE 0 END DESC, n DESC, dst) AS place FROM p JOIN labels ON dst = address)
  SELECT component, name, CASE WHEN category = 'exchange' THEN 'medium' ELSE 'low' END AS confidence FROM q WHERE place = 1""")
def g12(spark, sf):
    members = G.settle(G.components(_edges(spark, sf, FLOOR).toDF("a", "b")))
    out = transfers(spark, sf).join(members.withColumnRenamed("node", "src"), "src").groupBy("component", "dst").agg(F.count(F.lit(1)).alias("n"))
    outside = out.join(members.withColumnRenamed("node", "dst"), ["component", "dst"], "left_anti").join(labels(spark, sf).withColumnRenamed("address", "dst"), "dst")
    rank = F.when(F.col("category") == "exchange", 3).when(F.col("category").isin("bridge", "defi"), 1).otherwise(0)
    best = outside.groupBy("component").agg(F.max_by(F.struct("name", "category"), F.struct(rank, F.col("n"), -F.col("dst"))).alias("b"))
    return best.select("component", "b.name", F.when(F.col("b.category") == "exchange", "medium").otherwise("low").alias("confidence"))


@query("g13_multi_chain_addresses", f"WITH {T} SELECT src, count(DISTINCT chain) AS n_chains, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains FROM t WHERE usd > 10 GROUP BY src HAVING count(DISTINCT chain) >= 2")
def g13(spark, sf):
    per = transfers(spark, sf).where("usd > 10").groupBy("src").agg(F.array_sort(F.collect_set("chain")).alias("c"))  # as many as there are chains
    return per.where(F.size("c") >= 2).select("src", F.size("c").cast("long").alias("n_chains"), F.array_join("c", ",").alias("chains"))


@query("g14_cluster_merge", f"""WITH RECURSIVE {T}, links AS (SELECT DISTINCT src AS a, dst AS b FROM t WHERE usd > 10), {pair_components_sql("links")}, old AS (SELECT node, node % 40 AS cluster FROM c),
  k AS (SELECT src AS a, dst AS b FROM (SELECT DISTINCT c.component + 1000000 AS src, old.cluster AS dst FROM c JOIN old USING (node))), {components_sql("k", "z")} SELECT node AS cluster, component AS merged FROM z WHERE node < 1000000""")
def g14(spark, sf):
    members = G.settle(G.components(_edges(spark, sf, FLOOR).toDF("a", "b")))
    old = members.select("node", (F.col("node") % 40).alias("cluster"))
    ties = members.join(old, "node").select((F.col("component") + 1_000_000).alias("a"), F.col("cluster").alias("b")).distinct()
    return G.components(ties).where("node < 1000000").select(F.col("node").alias("cluster"), F.col("component").alias("merged"))


@query("g15_value_cycles", f"""WITH RECURSIVE {T}, {E.format(FLOOR)}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
  SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1""")
def g15(spark, sf):
    return G.strong_components(_edges(spark, sf, FLOOR))


@query("g16_consolidation_hubs", f"WITH {T} SELECT dst, count(DISTINCT src) AS n_sources, CAST(sum(usd) AS DOUBLE) AS usd FROM t WHERE usd > 10 GROUP BY dst HAVING count(DISTINCT src) >= 3")
def g16(spark, sf):
    hubs = transfers(spark, sf).where("usd > 10").groupBy("dst").agg(F.count_distinct("src").alias("n_sources"), money(F.sum("usd")).alias("usd"))
    return hubs.where("n_sources >= 3")


@query("g17_depth_from_seed", f"""WITH RECURSIVE {T}, {E.format(FLOOR)}, {reach_sql('s_suppkey = 1', 6)}, d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), a AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT node FROM d)
  SELECT node, CAST(coalesce(depth, (SELECT max(depth) FROM d) + 1) AS INTEGER) AS depth FROM a LEFT JOIN d USING (node)""")
def g17(spark, sf):
    edges = G.settle(_edges(spark, sf, FLOOR))
    found = G.bfs(edges, _seeds(spark, sf, "s_suppkey = 1"), None)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(found.select("node")).distinct()
    beyond = found.agg((F.max("depth") + 1).alias("beyond"))  # one row
    return nodes.join(found, "node", "left").crossJoin(F.broadcast(beyond)).select("node", F.coalesce("depth", "beyond").alias("depth"))


WEIGHTED = "w AS (SELECT src, dst, CAST(sum(usd) AS DOUBLE) AS usd FROM t WHERE usd > 10 GROUP BY src, dst), g AS (SELECT w.*, tot FROM w JOIN (SELECT src, CAST(sum(CAST(usd AS DECIMAL(20,4))) AS DOUBLE) AS tot FROM w GROUP BY src) USING (src))"


def step_sql(h: int) -> str:
    """CTEs s, f and b of hop h: candidates, improvements, best so far."""
    return f"""s{h} AS (SELECT source, g.dst AS node, max((weight * (g.usd / g.tot) * 0.7, path || '|' || g.dst || '|')) AS m FROM f{h - 1} f JOIN g ON g.src = f.node WHERE NOT contains(path, '|' || g.dst || '|') AND weight * (g.usd / g.tot) * 0.7 >= 1000 GROUP BY source, g.dst),
  f{h} AS (SELECT s.source, s.node, {h} AS hop, m[1] AS weight, m[2] AS path FROM s{h} s LEFT JOIN b{h - 1} b USING (source, node) WHERE b.weight IS NULL OR m[1] > b.weight),
  b{h} AS (SELECT * FROM b{h - 1} b WHERE NOT EXISTS (SELECT 1 FROM f{h} f WHERE f.source = b.source AND f.node = b.node) UNION ALL SELECT * FROM f{h})"""


@query("g18_indirect_exposure", f"""WITH {T}, {R}, {WEIGHTED}, f1 AS (SELECT src AS source, dst AS node, 1 AS hop, usd * 0.7 AS weight, '|' || src || '||' || dst || '|' AS path FROM g WHERE src IN (SELECT address FROM high_risk) AND usd * 0.7 >= 1000), b1 AS (SELECT * FROM f1),
  {step_sql(2)}, {step_sql(3)} SELECT source, node, CAST(hop AS INTEGER) AS hop, CAST(floor(weight) AS BIGINT) AS weight FROM b3""")
def g18(spark, sf):
    pairs = transfers(spark, sf).where("usd > 10").groupBy("src", "dst").agg(F.sum("usd").cast("decimal(20,4)").alias("usd"))
    risky = high_risk(spark, sf).select(F.col("address").alias("node"))
    return G.decayed_exposure(pairs, risky, 0.7, 3, 1000.0).withColumn("weight", F.floor("weight"))


HOPS = [1.0, 0.5, 0.25, 0.125]


@query("g19_label_exposure", f"""WITH {T}, {R}, p AS (SELECT src, dst, sum(usd) AS usd FROM t WHERE usd > 10 GROUP BY src, dst), v AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 9 = 0), h AS (SELECT address FROM high_risk),
  d AS (SELECT src AS victim, CAST(sum(usd) AS DOUBLE) AS drained FROM p WHERE src IN (SELECT node FROM v) GROUP BY src),
  s1 AS (SELECT v.node AS victim, dst, usd FROM v JOIN p ON p.src = v.node), s2 AS (SELECT victim, p.dst, p.usd FROM (SELECT DISTINCT victim, dst FROM s1) x JOIN p ON p.src = x.dst),
  s3 AS (SELECT victim, p.dst, p.usd FROM (SELECT DISTINCT victim, dst FROM s2) x JOIN p ON p.src = x.dst), s4 AS (SELECT victim, p.dst, p.usd FROM (SELECT DISTINCT victim, dst FROM s3) x JOIN p ON p.src = x.dst),
  y AS ({" UNION ALL ".join(f"SELECT victim, CAST(sum(usd) AS DOUBLE) * {w} AS value FROM s{k} WHERE dst IN (SELECT address FROM h) GROUP BY victim" for k, w in enumerate(HOPS, 1))})
  SELECT victim, round(sum(value) / any_value(drained), 6) AS exposure FROM y JOIN d USING (victim) GROUP BY victim""")
def g19(spark, sf):
    pairs = G.settle(transfers(spark, sf).where("usd > 10").groupBy("src", "dst").agg(F.sum("usd").alias("usd")))
    return G.label_exposure(pairs, _seeds(spark, sf, "s_suppkey % 9 = 0"), high_risk(spark, sf).select(F.col("address").alias("node")), HOPS)


@query("g20_peel_chains", f"""WITH RECURSIVE {T}, s AS (SELECT o_custkey AS account, o_orderdate AS at, min(o_orderkey) AS tx FROM orders GROUP BY ALL),
  p AS (SELECT t.tx_hash AS src, coalesce(s.tx, -t.dst) AS dst, sum(usd) AS usd FROM t ASOF LEFT JOIN s ON t.dst = s.account AND t.block_time <= s.at WHERE usd > 10 AND t.tx_hash <> coalesce(s.tx, -t.dst) GROUP BY ALL),
  l AS (SELECT src, arg_max(dst, (usd, -dst)) AS dst FROM p GROUP BY src HAVING count(*) >= 2 AND max(usd) * 100 >= sum(usd) * 60),
  w AS (SELECT src AS head, dst AS tail, 1 AS hops, [src, dst] AS path FROM l WHERE src NOT IN (SELECT dst FROM l) UNION ALL SELECT head, l.dst, hops + 1, list_append(path, l.dst) FROM w JOIN l ON l.src = w.tail WHERE NOT list_contains(path, l.dst)),
  m AS (SELECT head, arg_max(tail, hops) AS tail, max(hops) AS hops FROM w GROUP BY head) SELECT head, tail, CAST(hops AS INTEGER) AS hops, CASE WHEN hops >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM m WHERE hops >= 3""")
def g20(spark, sf):
    """Chains of transactions: a transfer leads to the next transaction of its receiver, who keeps it
    (a node of minus the account) where none follows."""
    outputs = transfers(spark, sf).where(f"usd > {FLOOR}").select(F.col("tx_hash").alias("src"), F.col("dst").alias("account"), F.col("block_time").alias("at"), "usd")
    spends = load(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("tx"))
    edges = next_spend(outputs, spends).select("src", F.coalesce("next", -F.col("account")).alias("dst"), "usd").where("src <> dst")
    return G.peel_chains(G.peel_links(edges, 60), 3, 5)


@query("g21_operator_graph", f"""WITH {T}, {R}, n AS (SELECT node, sum(usd) AS usd FROM (SELECT src AS node, usd FROM t UNION ALL SELECT dst, usd FROM t) GROUP BY node), k AS (SELECT *, row_number() OVER (ORDER BY usd DESC, node) AS place, count(*) OVER () AS c FROM n)
  SELECT node, CAST(usd AS DOUBLE) AS usd, risk_category, place, greatest(c - 50, 0) AS n_cut FROM k LEFT JOIN high_risk ON node = address WHERE place <= 50""")
def g21(spark, sf):
    legs = transfers(spark, sf).select(F.explode(F.array("src", "dst")).alias("node"), "usd").groupBy("node").agg(F.sum("usd").alias("total"))
    legs = G.settle(legs)
    top = legs.orderBy(F.desc("total"), "node").limit(50)  # the report's own node cap
    places = top.select(F.struct("total", (-F.col("node")).alias("m")).alias("s")).agg(F.sort_array(F.collect_list("s"), asc=False).alias("all")).select(F.posexplode("all").alias("p", "s"))  # of 50 rows
    risk = high_risk(spark, sf).select(F.col("address").alias("node"), "risk_category")
    cut = legs.agg(F.greatest(F.count(F.lit(1)) - 50, F.lit(0)).alias("n_cut"))
    out = places.select((-F.col("s.m")).alias("node"), money(F.col("s.total")).alias("usd"), (F.col("p") + 1).cast("long").alias("place"))
    return out.join(risk, "node", "left").crossJoin(F.broadcast(cut))


@query("g22_hop_tree", f"""WITH RECURSIVE {T}, p AS (SELECT src, dst, sum(usd) AS usd FROM t WHERE usd > 10 GROUP BY src, dst), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY usd DESC, dst) AS place FROM p),
  e AS (SELECT src, dst FROM k WHERE place <= 5), {reach_sql('s_suppkey = 2', 6)}, d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
  SELECT e.src, e.dst, CAST(depth + 1 AS INTEGER) AS depth FROM e JOIN d ON e.src = d.node WHERE depth < 6""")
def g22(spark, sf):
    pairs = transfers(spark, sf).where("usd > 10").groupBy("src", "dst").agg(F.sum("usd").alias("usd"))
    edges = G.settle(G.top_edges(pairs, 5, [F.desc("usd"), "dst"]).select("src", "dst"))
    found = G.bfs(edges, _seeds(spark, sf, "s_suppkey = 2"), 6).where("depth < 6")
    return edges.join(found.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")), "src")


@query("g23_unreachable_destinations", f"""WITH RECURSIVE {T}, {E.format(FLOOR)}, {reach_sql('s_suppkey % 3 = 0', 12)} SELECT DISTINCT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM r)""")
def g23(spark, sf):
    found = G.bfs(_edges(spark, sf, FLOOR), _seeds(spark, sf, "s_suppkey % 3 = 0"), None)
    return _seeds(spark, sf, "true").join(found, "node", "left_anti")


@query("g24_coinjoin", """WITH o AS (SELECT l_orderkey AS tx, CAST(floor(l_quantity / 10) AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT tx, max(n) AS equal, sum(n) AS outputs, count(*) FILTER (WHERE n >= 3) AS clusters FROM o GROUP BY tx)
  SELECT tx, equal, CAST(outputs AS BIGINT) AS outputs, CASE WHEN equal >= 5 THEN 'large' WHEN outputs = equal THEN 'even' ELSE 'mixed' END AS pattern FROM k WHERE clusters > 0""")
def g24(spark, sf):
    values = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("tx"), F.floor(F.col("l_quantity") / 10).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("tx").agg(F.max("n").alias("equal"), F.sum("n").alias("outputs")).where("equal >= 3")
    return found.select("tx", "equal", "outputs", F.when(F.col("equal") >= 5, "large").when(F.col("outputs") == F.col("equal"), "even").otherwise("mixed").alias("pattern"))


def _joint_inputs(spark, sf):
    """tx, inputs (sorted), target: a line is an input, the order's price the round amount."""
    lines = load(spark, sf, "lineitem")
    n = lines.count()
    lines = dealt(lines, "l_orderkey", n).groupBy(F.col("l_orderkey").alias("tx")).agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("inputs"))  # a transaction's own inputs
    orders = dealt(load(spark, sf, "orders"), "o_orderkey", n).select(F.col("o_orderkey").alias("tx"), (F.floor(F.col("o_totalprice") / 2000)).cast("long").alias("target"))
    return lines.join(orders, "tx")


@query("g25_coinjoin_unwrap")
def g25(spark, sf):
    """Checked against brute force in the tests; g25_small_sets has SQL."""
    return input_subsets(_joint_inputs(spark, sf), 1, 6, 200)


@query("g25_small_sets", """WITH i AS (SELECT l_orderkey AS tx, CAST(l_quantity AS BIGINT) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT)) - 1 AS i FROM lineitem),
  o AS (SELECT o_orderkey AS tx, CAST(floor(o_totalprice / 2000) AS BIGINT) AS target FROM orders),
  s AS (SELECT tx, CAST(i AS VARCHAR) AS subset, 1 AS n_inputs, v AS total FROM i
    UNION ALL SELECT tx, a.i || '|' || b.i, 2, a.v + b.v FROM i a JOIN i b USING (tx) WHERE a.i < b.i
    UNION ALL SELECT tx, a.i || '|' || b.i || '|' || c.i, 3, a.v + b.v + c.v FROM i a JOIN i b USING (tx) JOIN i c USING (tx) WHERE a.i < b.i AND b.i < c.i)
  SELECT tx, subset, CAST(n_inputs AS BIGINT) AS n_inputs, CAST(total - target AS BIGINT) AS excess, false AS truncated FROM s JOIN o USING (tx) WHERE total - target BETWEEN 0 AND 3""")
def g25_small(spark, sf):
    """All sets of one to three inputs."""
    return input_subsets(_joint_inputs(spark, sf), 3, 3, 10**9)


@query("g26_merge_passes", f"WITH {T}, a AS (SELECT DISTINCT * FROM t WHERE usd > 40000 UNION SELECT DISTINCT * FROM t WHERE chain = 'A') SELECT src, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd FROM a GROUP BY src")
def g26(spark, sf):
    t = transfers(spark, sf)
    both = t.where("usd > 40000").unionByName(t.where("chain = 'A'")).dropDuplicates()
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"))


@query("g7_swap_continuation", f"""WITH RECURSIVE {T}, legs AS (SELECT DISTINCT tx_hash AS tx, log_index AS log, token, src, dst, usd FROM t), k AS (SELECT tx, token, bool_or(log = 1) AS given, sum(usd) AS total, arg_max(dst, (usd, -dst)) AS receiver FROM legs GROUP BY tx, token),
  r0 AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY total DESC, token) AS place FROM k WHERE NOT given AND total > 0), e AS (SELECT DISTINCT l.src, r0.receiver AS dst FROM legs l JOIN r0 USING (tx) WHERE log = 1 AND place = 1), {reach_sql('s_suppkey % 5 = 0', 3)}
  SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def g7(spark, sf):
    """What a traced address swaps goes on at whoever got the swap's output, in three rounds."""
    legs = transfers(spark, sf).select(F.col("tx_hash").alias("tx"), F.col("log_index").alias("log"), "token", "src", "dst", "usd").distinct()
    outputs = swap_outputs(legs.withColumnRenamed("dst", "receiver").withColumn("is_input", F.col("log") == 1))
    swaps = legs.where("log = 1").select("tx", "src").distinct().join(outputs.select("tx", F.col("receiver").alias("dst")), "tx").select("src", "dst").distinct()
    return G.bfs(G.settle(swaps), _seeds(spark, sf, "s_suppkey % 5 = 0"), 3)


@query("g27_multi_chain_pivot", f"""WITH RECURSIVE {T}, e AS (SELECT DISTINCT chain, src, dst FROM t WHERE usd > 10), r AS (SELECT c.chain, s_suppkey AS node, 0 AS depth FROM supplier, (VALUES ('N'), ('R')) c(chain) WHERE s_suppkey = 7 UNION SELECT r.chain, e.dst, depth + 1 FROM r JOIN e ON e.chain = r.chain AND e.src = r.node WHERE depth < 2)
  SELECT chain, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY chain, node""")
def g27(spark, sf):
    """A hub of one chain is traced on every other in one walk, whose nodes carry their chain."""
    at = lambda c: F.struct("chain", F.col(c).alias("address"))
    edges = transfers(spark, sf).where(f"usd > {FLOOR}").select(at("src").alias("src"), at("dst").alias("dst")).distinct()
    hub = load(spark, sf, "supplier").where("s_suppkey = 7").select(F.explode(F.array(F.lit("N"), F.lit("R"))).alias("chain"), F.col("s_suppkey").alias("a")).select(at("a").alias("node"))
    return G.bfs(edges, hub, 2).select("node.chain", F.col("node.address").alias("node"), "depth")


@query("g1_policy_trace", f"""WITH RECURSIVE {T}, {L}, a AS (
    SELECT t.*, CASE WHEN dst % 50 = 0 THEN 0 WHEN dst % 47 = 0 THEN 1 WHEN category IN ('exchange', 'mixer', 'bridge') THEN 2 WHEN dst % 9 = 0 THEN 3 END AS stop
    FROM t LEFT JOIN labels ON dst = address AND added_at <= block_time AND (valid_from IS NULL OR valid_from <= block_time) AND (valid_until IS NULL OR valid_until >= block_time)
    WHERE CASE WHEN token % 10 <> 0 THEN usd >= 10 ELSE amt >= 0.001 END),
  e AS (SELECT DISTINCT src, dst, stop FROM a), busy AS (SELECT src AS node FROM a WHERE src NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 1) GROUP BY src HAVING count(*) > 30),
  w AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey % 5 = 1 UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = node WHERE stop IS NULL AND depth + 1 < 3 AND node NOT IN (SELECT node FROM busy)),
  walked AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), open AS (SELECT * FROM walked WHERE node NOT IN (SELECT node FROM busy)),
  reached AS (SELECT e.dst AS node, min(depth + 1) AS reached, min(stop) AS stop FROM e JOIN open ON src = node GROUP BY e.dst)
  SELECT node, least(reached, depth) AS depth, depth IS NOT NULL AND node NOT IN (SELECT node FROM busy) AS followed,
    CASE WHEN depth IS NOT NULL AND node NOT IN (SELECT node FROM busy) THEN NULL WHEN depth IS NOT NULL THEN 'service wallet' WHEN stop IS NOT NULL THEN ['burn', 'placeholder', 'service label', 'contract'][stop + 1] ELSE 'depth' END AS stopped
  FROM reached FULL JOIN walked USING (node)""")
def g1_policy(spark, sf):
    """A trace in which each rule stops some branch: burns, placeholders, labels as they were at the time, contracts,
    busy wallets, depth; every tenth token has no price.  An account's own address begins with a one, for after
    zeros some numbers would read as a burn (57005 is dead)."""
    rows = transfers(spark, sf).withColumn("usd", F.when(F.col("token") % 10 != 0, F.col("usd")))
    address = F.when(F.col("dst") % 50 == 0, F.lit("0x" + "0" * 36 + "dEaD")).when(F.col("dst") % 47 == 0, F.concat(F.lit("exchange:"), F.col("dst"))).otherwise(F.concat(F.lit("0x1"), F.lpad(F.hex("dst"), 39, "0")))
    contracts = _seeds(spark, sf, "s_suppkey % 9 = 0")
    return G.policy_trace(rows.withColumn("address", address), _seeds(spark, sf, "s_suppkey % 5 = 1"), labels(spark, sf), contracts, 3, service_outflows=30)


@query("k8_cluster_membership", """WITH RECURSIVE g AS (SELECT DISTINCT c_nationkey AS nation, o_custkey AS a, o_orderdate AS day FROM orders JOIN customer ON o_custkey = c_custkey),
  links AS (SELECT DISTINCT x.a, y.a AS b FROM g x JOIN g y ON x.nation = y.nation AND x.day = y.day AND x.a <> y.a),
  r AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.node WHERE r.root < l.b)
  SELECT node, min(root) AS root FROM r GROUP BY node""")
def k8(spark, sf):
    """Customers of one nation that ordered on the same day, in three batches of years: each batch only touches the
    clusters that its groups reach, and the last membership has the components of all."""
    days = load(spark, sf, "orders").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    days = days.select(F.concat_ws("|", "c_nationkey", F.to_date("o_orderdate")).alias("group_id"), F.col("o_custkey").cast("string").alias("address"), F.lit("x").alias("chain"), (F.year("o_orderdate") % 3).alias("batch"))
    held = spark.createDataFrame([], "address string, chain string, cluster_id string")
    for batch in range(3):
        held, _ = G.grown_clusters(held, days.where(F.col("batch") == batch).select("group_id", "address", "chain"))
    node = F.col("address").cast("long")
    return held.select(node.alias("node"), "cluster_id").join(held.groupBy("cluster_id").agg(F.min(node).alias("root")), "cluster_id").select("node", "root")
