"""Projections and predicates (P), scalar functions (F) and landing-table scans (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.functions import checksums as K
from ledgertide.functions import expressions as X
from ledgertide.functions.checksums import chain_family
from ledgertide.operators import tokens
from ledgertide.operators.aggregates import money
from ledgertide.plans.domain import L, T, dealt, labels, load, transfers
from ledgertide.plans.registry import query
from ledgertide.sources import landing

EVM = "'0x' || substr(sha256(CAST({0} AS VARCHAR)), 1, 40)"


def evm(key: str):
    return F.concat(F.lit("0x"), F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 40))


@query("p1_canonical_key", f"""WITH a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' 0x' || upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 40)) WHEN 1 THEN c_name || ' ' END AS raw FROM customer)
  SELECT c_custkey, CASE WHEN regexp_full_match(trim(raw), '0x[0-9a-fA-F]{{40}}') THEN lower(trim(raw)) ELSE coalesce(trim(raw), '') END AS key FROM a""")
def p1(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" 0x"), F.upper(F.substring(evm("c_custkey"), 3, 40)))).when(F.col("c_custkey") % 3 == 1, F.concat("c_name", F.lit(" ")))
    return load(spark, sf, "customer").select("c_custkey", X.canonical_key(raw).alias("key"))


def every_core(rows):
    """Narrow rows that meet Python or wide expressions: dealt over all cores, for a file may be one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


#: Public examples of each family.
EXAMPLES = [
    ("bitcoin", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"), ("bitcoin", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy"), ("bitcoin", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"), ("bitcoin", "bc1p5cyxnuxmeuwuvkwfem96lqzszd02n6xdcjrs20cac6yqjjwudpxqkedrcr"),
    ("tron", "TNUC9Qb1rRpS5CbWLmNMxXBjyFoydXjWFR"), ("stellar", "GA7QYNF7SOWQ3GLR2BGMZEHXAVIRZA4KVWLTJJFC7MGXUA74P7UJVSGZ"), ("ton", "EQCD39VS5jcptHL8vMjEXrzGaRcCVYto7HUn4bpAOg8xqB2N"), ("solana", "So11111111111111111111111111111111111111112"),
]


@query("p2_chain_families", f"""WITH e(i, family) AS (VALUES {", ".join(f"({i}, '{f}')" for i, (f, _) in enumerate(EXAMPLES))}), a AS (SELECT c_custkey, c_custkey // 2 % 10 AS i, c_custkey % 2 = 1 AS broken FROM customer)
  SELECT c_custkey, CASE WHEN a.i = 8 THEN 'evm' WHEN a.i = 9 THEN 'move' WHEN broken THEN 'unknown' ELSE family END AS family FROM a LEFT JOIN e USING (i)""")
def p2(spark, sf):
    """Also F17: real addresses, each also with its middle character changed; where there is no checksum, one too few."""
    shown = F.element_at(F.array(*(F.lit(a) for _, a in EXAMPLES)), (F.col("i") + 1).cast("int"))
    middle = F.floor(F.length("shown") / 2).cast("int")
    other = F.when(F.col("i") == 7, F.substring("shown", F.lit(1), F.length("shown") - 1)).otherwise(F.concat(F.substring("shown", F.lit(1), middle), F.when(F.substring("shown", middle + 1, F.lit(1)).isin("q", "Q", "7"), F.when(F.col("i") == 5, "A").otherwise("z")).otherwise(F.when(F.col("i") == 5, "7").otherwise("q")), F.substring("shown", middle + 2, F.length("shown"))))
    rows = every_core(load(spark, sf, "customer").select("c_custkey")).select("c_custkey", (F.floor(F.col("c_custkey") / 2) % 10).alias("i"))
    rows = rows.withColumn("shown", F.when(F.col("i") == 8, evm("c_custkey")).when(F.col("i") == 9, X.move_address(evm("c_custkey"))).otherwise(F.when(F.col("i") < 8, shown)))
    address = F.when((F.col("c_custkey") % 2 == 1) & (F.col("i") < 8), other).otherwise(F.col("shown"))
    return rows.select("c_custkey", chain_family(address).alias("family"))


#: Public test vectors of segwit addresses with their kinds (none: refused), and others with theirs.
SEGWIT_VECTORS = [
    ("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", "p2wpkh"), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "p2wpkh"), ("bc1qrp33g0q5c5txsp9arysrx4k6zdkfs4nce4xj0gdcccefvpysxf3qccfmv3", "p2wsh"),
    ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "p2tr"), ("bc1pw508d6qejxtdg4y5r3zarvary0c5xw7kw508d6qejxtdg4y5r3zarvary0c5xw7kt5nd6y", "witness_v1"), ("BC1SW50QGDZ25J", "witness_v16"), ("bc1zw508d6qejxtdg4y5r3zarvaryvaxxpcs", "witness_v2"),
    ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", None), ("bc1qr508d6qejxtdg4y5r3zarvaryv98gj9p", None), ("BC130XLXVLHEMJA6C4DQV22UAPCTQUPFHLXM9H8Z3K2E72Q4K9HCZ7VQ7ZWS8R", None), ("bc130xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vq7zws8r", None),
    ("bc1pw5dgrnzv", None), ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7v8n0nx0muaewav253zgeav", None), ("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqh2y7hd", None), ("bc1q0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", None), ("bc1zw508d6qejxtdg4y5r3zarvaryvqyzf3du", None),
    ("Bc1qW508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", None), ("tb1qw508d6qejxtdg4y5r3zarvary0c5xw7kxpjzsx", None), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "p2pkh"), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", None), ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "p2sh"), ("2N1SP7r92ZZJvYKG2oNtzPwYnzw62up7mTo", None),
]


@query("f17_address_codecs", f"""WITH v(i, raw, kind) AS (VALUES {", ".join(f"({i}, '{a}', " + (f"'{k}')" if k else "NULL)") for i, (a, k) in enumerate(SEGWIT_VECTORS))})
  SELECT c_custkey, kind, CASE WHEN kind IS NOT NULL THEN CASE WHEN lower(raw[:3]) = 'bc1' THEN lower(raw) ELSE raw END END AS key, CASE WHEN kind IS NULL THEN 'unknown' ELSE 'bitcoin' END AS family,
    CASE WHEN c_custkey % 2 = 0 THEN '0x891cdb91d149f23b1a45d9c5ca78a88d0cb44c18' END AS tron FROM customer JOIN v ON i = c_custkey % {len(SEGWIT_VECTORS)}""")
def f17(spark, sf):
    """Valid and invalid addresses of the published vectors, with blanks about them; a tron address, each other one broken."""
    shown = F.concat(F.lit(" "), F.element_at(F.array(*(F.lit(a) for a, _ in SEGWIT_VECTORS)), (F.col("c_custkey") % len(SEGWIT_VECTORS) + 1).cast("int")))
    tron = F.when(F.col("c_custkey") % 2 == 0, "TNUC9Qb1rRpS5CbWLmNMxXBjyFoydXjWFR").otherwise("TNUC9Qb1rRpS5CbWLmNMxXBjyFoydXjWFr")
    return every_core(load(spark, sf, "customer").select("c_custkey")).select("c_custkey", K.bitcoin_address_kind(shown).alias("kind"), K.bitcoin_key(shown).alias("key"), K.chain_family(shown).alias("family"), K.tron_as_hex(tron).alias("tron"))


@query("p3_inclusion", f"WITH {T}, p AS (SELECT *, CASE WHEN token % 10 <> 0 THEN usd END AS price FROM t) SELECT chain, count(*) AS n FROM p WHERE NOT coalesce(price < 10000, false) AND NOT (price IS NULL AND amt < 5) GROUP BY chain")
def p3(spark, sf):
    price = F.when(F.col("token") % 10 != 0, F.col("usd"))
    rows = transfers(spark, sf).withColumn("price", price).where("NOT coalesce(price < 10000, false) AND NOT (price IS NULL AND amt < 5)")
    return rows.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


@query("p5_sinks", f"""WITH {T}, pools AS (SELECT s_suppkey AS dst FROM supplier WHERE s_suppkey % 13 = 0), a AS (SELECT t.*, t.dst % 50 = 0 AS burn, t.dst IN (SELECT dst FROM pools) AS pool FROM t)
  SELECT CASE WHEN burn THEN 'burn' WHEN pool THEN 'mixer' ELSE 'other' END AS sink, count(*) AS n, CAST(sum(usd) AS DOUBLE) AS usd FROM a GROUP BY ALL""")
def p5(spark, sf):
    """Also P6: burn addresses by their form (all zeros, or dead at the end), mixers by their table of pools."""
    address = F.when(F.col("dst") % 100 == 0, F.lit("0x" + "0" * 40)).when(F.col("dst") % 50 == 0, F.lit("0x" + "0" * 36 + "dEaD")).otherwise(evm("dst"))
    pools = load(spark, sf, "supplier").where("s_suppkey % 13 = 0").select(F.col("s_suppkey").alias("dst"), F.lit(True).alias("pool"))
    sink = F.when(X.is_burn(address), "burn").when(F.col("pool"), "mixer").otherwise("other")
    return transfers(spark, sf).join(pools, "dst", "left").groupBy(sink.alias("sink")).agg(F.count(F.lit(1)).alias("n"), money(F.sum("usd")).alias("usd"))


@query("p4_traversal", f"""WITH {T}, {L}, a AS (SELECT t.*, category, log_index % 3 AS depth FROM t LEFT JOIN labels ON dst = address)
  SELECT chain, count(*) AS n FROM a WHERE depth + 1 < 3 AND dst % 50 <> 0 AND coalesce(category, '') NOT IN ('exchange', 'mixer', 'bridge') AND dst % 9 <> 0 GROUP BY chain""")
def p4(spark, sf):
    """Which transfers' receivers are followed: not beyond the depth, not into burns or placeholders, not into
    exchanges, mixers and bridges, not into contracts."""
    known = labels(spark, sf).select(F.col("address").alias("dst"), "category")
    address = F.when(F.col("dst") % 50 == 0, F.lit("0x" + "0" * 40)).otherwise(evm("dst"))
    rows = transfers(spark, sf).join(known, "dst", "left")
    go = X.traverses(F.col("log_index") % 3, 3, address, F.col("category"), F.col("dst") % 9 == 0)
    return rows.where(go).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


@query("p13_spam_contracts", "WITH s AS (SELECT l_partkey AS token, count(*) AS n, bool_or(l_quantity >= 49) AS phish FROM lineitem GROUP BY l_partkey), k AS (SELECT token FROM s WHERE n >= 20 AND phish) SELECT l_partkey IN (SELECT token FROM k) AS spam, count(*) AS n FROM lineitem GROUP BY ALL")
def p13(spark, sf):
    lines = load(spark, sf, "lineitem")
    spam = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_quantity") >= 49).alias("phish")).where("n >= 20 AND phish").select("l_partkey", F.lit(True).alias("spam"))
    return lines.join(spam, "l_partkey", "left").groupBy(F.coalesce("spam", F.lit(False)).alias("spam")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_usd_strings", """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) AS usd FROM orders""")
def p17(spark, sf):
    shown = X.format_usd(F.col("o_totalprice").cast("decimal(20,2)"))
    return load(spark, sf, "orders").select("o_orderkey", money(X.parse_usd(shown)).alias("usd"))


@query("f1_shape_similarity", f"""WITH a AS (SELECT c_custkey, c_custkey % 4 AS turn, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 40) AS x FROM customer),
  b AS (SELECT *, CASE turn WHEN 0 THEN x WHEN 1 THEN left(x, 4) || repeat('0', 32) || right(x, 4) WHEN 2 THEN left(x, 4) || repeat('1', 36) ELSE repeat('2', 39) END AS y FROM a)
  SELECT c_custkey, CASE WHEN x = y THEN 1.0::DOUBLE ELSE round(CASE WHEN left(x, 4) = left(y, 4) THEN 0.48::DOUBLE ELSE 0 END + CASE WHEN right(x, 4) = right(y, 4) THEN 0.48::DOUBLE ELSE 0 END
  + ({" + ".join(f"CAST(substr(x, {k}, 1) = substr(y, {k}, 1) AS INTEGER)" for k in range(8, 15))}) * 0.04::DOUBLE / 7, 6) END AS similarity FROM b
  UNION ALL SELECT -c_custkey, 0.0 FROM customer""")
def f1(spark, sf):
    """Against itself in capitals, an address with the same ends, one with the same beginning, and another; and
    against text that isn't an address."""
    x = F.substring(evm("c_custkey"), 3, 40)
    made = F.when(F.col("c_custkey") % 4 == 0, F.upper(x)).when(F.col("c_custkey") % 4 == 1, F.concat(F.left(x, F.lit(4)), F.lit("0" * 32), F.right(x, F.lit(4)))).when(F.col("c_custkey") % 4 == 2, F.concat(F.left(x, F.lit(4)), F.lit("1" * 36))).otherwise(F.lit("2" * 39))
    rows = load(spark, sf, "customer")
    alike = rows.select("c_custkey", X.shape_similarity(evm("c_custkey"), F.concat(F.lit("0x"), made)).alias("similarity"))
    return alike.union(rows.select(-F.col("c_custkey"), X.shape_similarity(evm("c_custkey"), F.lit("0xnot an address"))))


ROUND = "(1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000)"


@query("f3_round_amounts", f"WITH a AS (SELECT CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE 500 END + CASE WHEN l_linenumber = 3 THEN 0.5 ELSE 0 END AS amount FROM lineitem) SELECT amount = floor(amount) AND CAST(floor(amount) AS BIGINT) IN {ROUND} AS round_amount, count(*) AS n FROM a GROUP BY ALL")
def f3(spark, sf):
    amount = F.col("l_quantity").cast("long") * F.when(F.col("l_linenumber") % 2 == 0, 50).otherwise(500) + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.0)
    return load(spark, sf, "lineitem").groupBy(X.looks_round(amount, X.ROUND_AMOUNTS).alias("round_amount")).agg(F.count(F.lit(1)).alias("n"))


@query("f9_deadlines", "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS due, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS age FROM orders")
def f9(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.expr("o_orderdate + INTERVAL '3' MONTH").alias("due"), F.datediff(F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), "o_orderdate").cast("long").alias("age"))


@query("f19_explorer_urls", f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://etherscan.io/address/' ELSE 'https://basescan.org/address/' END || {EVM.format('c_custkey')} AS url FROM customer")
def f19(spark, sf):
    chain = F.when(F.col("c_custkey") % 2 == 0, "ethereum").otherwise("base")
    return load(spark, sf, "customer").select("c_custkey", X.explorer_url(chain, evm("c_custkey")).alias("url"))


@query("f20_entities", f"""SELECT c_custkey, 1::BIGINT AS n_addresses, {EVM.format("c_custkey")} AS address, '0x' || sha256(CAST(c_custkey AS VARCHAR)) AS tx_hash, CASE c_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN c_custkey % 2 = 0 THEN 'arbitrum,ethereum' ELSE '' END AS chains FROM customer""")
def f20(spark, sf):
    """Addresses, transactions, amount by severity and chains in free text; an address inside a hash is none."""
    text = F.concat(F.lit("Drained: "), evm("c_custkey"), F.lit(" twice, "), evm("c_custkey"), F.lit(" in 0x"), F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256), F.when(F.col("c_custkey") % 3 == 0, " for $120M").when(F.col("c_custkey") % 3 == 1, " for $2.5 million").otherwise(""), F.when(F.col("c_custkey") % 2 == 0, " on Ethereum and Arbitrum.").otherwise("."))
    return load(spark, sf, "customer").select("c_custkey", X.entities(text).alias("e")).select("c_custkey", F.size("e.addresses").cast("long").alias("n_addresses"), F.get("e.addresses", F.lit(0)).alias("address"), F.get("e.tx_hashes", F.lit(0)).alias("tx_hash"), "e.severity", F.array_join("e.chains", ",").alias("chains"))


@query("f22_content_hash", "SELECT doc_id, sha256(source || '|' || lang || '|' || coalesce(text, '')) AS hash FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def f22(spark, sf):
    return load(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", X.content_hash(F.col("source"), F.col("lang"), F.coalesce("text", F.lit(""))).alias("hash"))


@query("f26_percentages", "SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) * 100, 6) AS pct FROM orders GROUP BY ALL")
def f26(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(X.percentage(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))), 6).alias("pct"))


@query("s2_block_at_or_before", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS block FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def s2(spark, sf):
    at = F.expr("ts <= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return load(spark, sf, "events").where(at).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("block"))


@query("s3_outflow_scan", f"WITH {T} SELECT tx_hash, log_index, dst, token, CAST(usd AS DOUBLE) AS usd FROM t WHERE src = 7 AND tx_hash >= 1000")
def s3(spark, sf):
    return landing.outflows(transfers(spark, sf), F.lit(7), F.lit(1000)).select("tx_hash", "log_index", "dst", "token", money(F.col("usd")).alias("usd"))


@query("s5_inflow_scan", f"WITH {T} SELECT tx_hash, log_index, src, token, CAST(usd AS DOUBLE) AS usd FROM t WHERE dst = 7")
def s5(spark, sf):
    return landing.inflows(transfers(spark, sf), F.lit(7)).select("tx_hash", "log_index", "src", "token", money(F.col("usd")).alias("usd"))


@query("s7_event_log_scan", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def s7(spark, sf):
    logs = load(spark, sf, "events").select("event_id", "user_id", F.array("event_type").alias("topics"), F.get_json_object("props", "$.k").cast("long").alias("block"))
    return landing.event_logs(logs, "click", 10, 20).select("event_id", "user_id")


@query("s14_utxo_normaliser", """WITH x AS (SELECT l_orderkey AS tx, l_linenumber AS output_index, l_suppkey AS dst, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount FROM lineitem) SELECT tx, o_custkey AS src, dst, output_index, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM x JOIN orders ON tx = o_orderkey GROUP BY ALL""")
def s14(spark, sf):
    lines = load(spark, sf, "lineitem")
    n = lines.count()
    outputs = dealt(lines, "l_orderkey", n).groupBy(F.col("l_orderkey").alias("tx")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("output_index"), F.col("l_suppkey").alias("address"), F.col("l_extendedprice").cast("decimal(12,2)").alias("value"))).alias("outputs"))  # a transaction's own outputs
    inputs = dealt(load(spark, sf, "orders"), "o_orderkey", n).select(F.col("o_orderkey").alias("tx"), F.array(F.struct(F.col("o_custkey").alias("address"))).alias("inputs"))
    rows = landing.utxo_transfers(outputs.join(inputs, "tx"))
    return rows.groupBy("tx", "src", "dst", "output_index").agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("amount"))


@query("s24_precedence_union", "WITH u AS (SELECT c_custkey AS address, c_mktsegment AS category, 2 AS rank FROM customer UNION ALL SELECT s_suppkey, 'listed', 1 FROM supplier) SELECT address, arg_min(category, rank) AS category FROM u GROUP BY address")
def s24(spark, sf):
    first = load(spark, sf, "supplier").selectExpr("s_suppkey AS address", "'listed' AS category")
    second = load(spark, sf, "customer").selectExpr("c_custkey AS address", "c_mktsegment AS category")
    return landing.by_precedence([first, second], "address").select("address", "category")


@query("s28_contact_overrides", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey <= (SELECT max(c_custkey) FROM customer) THEN c_name ELSE s_name END AS contact FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND s_suppkey % 4 = 0")
def s28(spark, sf):
    overrides = load(spark, sf, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey AS s_suppkey", "c_name AS override")
    return load(spark, sf, "supplier").join(overrides, "s_suppkey", "left").select("s_suppkey", F.coalesce("override", "s_name").alias("contact"))


@query("k6_upsert_observations", """WITH u AS (SELECT o_custkey AS address, o_orderpriority AS role, o_orderdate AS observed_at, o_orderkey AS ref FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY address, role ORDER BY observed_at DESC, ref DESC) AS place FROM u) SELECT address, role, observed_at, ref FROM r WHERE place = 1""")
def k6(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_custkey AS address", "o_orderpriority AS role", "o_orderdate AS observed_at", "o_orderkey AS ref")
    return landing.upsert(rows.where("ref % 2 = 0"), rows.where("ref % 2 = 1"), ["address", "role"], ["observed_at", "ref"])


@query("k7_upsert_watchlist", """WITH o AS (SELECT c_custkey AS id, c_mktsegment AS role, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'hot' END AS role, c_acctbal + 1 AS balance FROM customer WHERE c_custkey % 5 <> 0)
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.role, o.role) AS role, coalesce(n.balance, o.balance) AS balance FROM o FULL JOIN n ON o.id = n.id""")
def k7(spark, sf):
    c = load(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_mktsegment AS role", "c_acctbal AS balance")
    new = c.where("c_custkey % 5 <> 0").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'hot' END AS role", "c_acctbal + 1 AS balance")
    return landing.overlay(old, new, ["id"])


@query("k9_insert_if_absent", "SELECT event_id, user_id FROM events WHERE event_id % 10 NOT IN (SELECT DISTINCT event_id % 10 FROM events WHERE event_id % 10 < 4)")
def k9(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 10).alias("dedup_key"))
    return landing.absent(events, events.where("dedup_key < 4"), ["dedup_key"]).select("event_id", "user_id")


@query("p13_airdrop_spam", """WITH l AS (SELECT l_suppkey AS src, l_partkey AS k, CASE WHEN l_partkey % 17 <> 0 THEN 'c' || l_partkey % 40 END AS contract, CASE WHEN l_partkey % 40 = 7 THEN 'Visit claim' || l_partkey || '.XYZ' ELSE 'T' END AS symbol, CASE WHEN l_partkey % 40 % 3 <> 1 THEN 'id' END AS price_id FROM lineitem),
  s AS (SELECT src, contract FROM l WHERE contract IS NOT NULL AND price_id IS NULL GROUP BY ALL HAVING count(*) >= 25 OR bool_or(symbol <> 'T'))
  SELECT src, contract, (src, contract) IN (SELECT (src, contract) FROM s) AND contract IS NOT NULL AS dropped, count(*) AS n FROM l GROUP BY ALL""")
def p13_spam(spark, sf):
    """Each sender's transfers, without tokens that have no price and are sent round, or whose symbol is a lure."""
    kind = F.col("l_partkey") % 40
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.when(F.col("l_partkey") % 17 != 0, F.concat(F.lit("c"), kind)).alias("contract"), F.when(kind == 7, F.concat(F.lit("Visit claim"), F.col("l_partkey"), F.lit(".XYZ"))).otherwise("T").alias("symbol"), F.when(kind % 3 != 1, "id").alias("price_id"))
    return tokens.without_spam(rows, ["src"]).groupBy("src", "contract", "dropped").agg(F.count(F.lit(1)).alias("n"))


@query("p14_case_index", """WITH c AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' TEST' WHEN 2 THEN 'Validation of ' || c_name WHEN 3 THEN 'contest ' || c_name WHEN 4 THEN ' Phase 2 run' WHEN 5 THEN '  ' WHEN 7 THEN 'a sample  case' END AS name, c_custkey % 9 <> 8 AS has_record FROM customer)
  SELECT c_custkey, CASE WHEN NOT has_record THEN 'no victim record' WHEN c_custkey % 9 IN (5, 6) THEN 'empty victim name' WHEN c_custkey % 9 IN (1, 2, 4, 7) THEN 'marked as a test' END AS reason FROM c""")
def p14_index(spark, sf):
    key = F.col("c_custkey") % 9
    name = F.when(key == 0, F.col("c_name")).when(key == 1, F.concat("c_name", F.lit(" TEST"))).when(key == 2, F.concat(F.lit("Validation of "), "c_name")).when(key == 3, F.concat(F.lit("contest "), "c_name")).when(key == 4, " Phase 2 run").when(key == 5, "  ").when(key == 7, "a sample  case")
    return load(spark, sf, "customer").select("c_custkey", tokens.case_is_test(name, key != 8).alias("reason"))


@query("a20_token_verdicts", """WITH s AS (SELECT l_partkey AS p_partkey, count(*) FILTER (WHERE l_returnflag = 'N') AS buys, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 4) AS sells FROM lineitem GROUP BY ALL),
  t AS (SELECT p_partkey, coalesce(buys, 0) AS buys, coalesce(sells, 0) AS sells, p_partkey % 2 + p_partkey // 2 % 2 AS traps, p_size = 50 AS pulled, p_partkey % 31 = 0 AS honeypot, p_partkey % 7 = 0 AS unsellable, p_partkey % 5 = 0 AS hidden, p_partkey % 3 = 0 AS proxy FROM part LEFT JOIN s USING (p_partkey)),
  g AS (SELECT *, CASE WHEN sells > 0 THEN 0 WHEN buys >= 20 THEN 4 WHEN buys >= 5 THEN 3 WHEN buys >= 1 THEN 2 ELSE 0 END AS unsold FROM t),
  k AS (SELECT *, CAST(unsellable AS INT) + CAST(hidden AS INT) + CASE WHEN unsold = 3 THEN 1 ELSE 0 END AS serious FROM g)
  SELECT p_partkey, CAST(traps + CASE WHEN unsold > 0 THEN 1 ELSE 0 END + CAST(pulled AS INT) + CAST(honeypot AS INT) + CAST(unsellable AS INT) + CAST(hidden AS INT) + CAST(proxy AS INT) AS INTEGER) AS n_signals,
    CASE WHEN unsold = 4 OR honeypot THEN 10 WHEN pulled THEN 9 WHEN serious >= 2 THEN 7 WHEN serious = 1 THEN 5 WHEN traps > 0 OR unsold = 2 THEN 3 WHEN proxy THEN 1 ELSE 0 END AS score,
    CASE WHEN unsold = 4 OR honeypot THEN 'honeypot' WHEN pulled OR serious >= 2 THEN 'high_risk_rug' WHEN serious = 1 THEN 'medium_risk' WHEN traps > 0 OR unsold = 2 OR proxy THEN 'low_risk' ELSE 'clean' END AS verdict FROM k""")
def a20_verdicts(spark, sf):
    """Every signal of a token's code, trades, pool and service flags, and the ladder of verdicts."""
    trades = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_returnflag") == "N").alias("buys"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 4)).alias("sells"))
    key = F.col("p_partkey")
    code = F.concat(F.lit("0x6080"), F.when(key % 2 == 1, "DC1052E2").otherwise(""), F.lit("00"), F.when(F.floor(key / 2) % 2 == 1, "44337ea1").otherwise(""))
    flag = lambda n: F.when(key % n == 0, "1").otherwise("0")
    rows = load(spark, sf, "part").join(trades, "p_partkey", "left")
    rows = rows.select("p_partkey", tokens.token_signals(code, F.col("buys"), F.col("sells"), F.col("p_size") == 50, {"is_honeypot": flag(31), "cannot_sell_all": flag(7), "hidden_owner": flag(5), "is_proxy": flag(3)}).alias("signals"))
    return rows.select("p_partkey", F.size("signals").alias("n_signals"), tokens.token_verdict(F.col("signals")).alias("v")).select("p_partkey", "n_signals", "v.*")
