"""Chain normalisers and the scans beside them (S): landing records are written from the mapped
tables in each chain's own layout; the SQL says which transfers they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.plans.domain import load
from ledgertide.plans.registry import query
from ledgertide.sources import chains


def shown(df: DataFrame) -> DataFrame:
    return df.select("chain", "tx_hash", "ordinal", "block_time", "src", "dst", "token", "amount", "decimals")


def orders(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp_ltz"))).alias("at"), F.col("o_orderdate").alias("day"))


def name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


FROM = "FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS day FROM orders)"


@query("s10_evm_adapter", f"""SELECT CASE WHEN k % 2 = 0 THEN 'ethereum' ELSE 'base' END AS chain, '0xh' || k AS tx_hash, k % 5 AS ordinal, day AS block_time, '0xa' || c AS src, '0xb' || c AS dst, CASE WHEN k % 3 = 0 THEN '' ELSE '0xc0' END AS token,
  CAST(k * 1000000000000::HUGEINT + 7 AS DECIMAL(38,0)) AS amount, CASE k % 3 WHEN 0 THEN 18 WHEN 1 THEN 6 ELSE 36 END AS decimals {FROM} WHERE k % 7 NOT IN (0, 1)""")
def s10(spark, sf):
    k = F.col("k")
    value = F.when(k % 7 == 1, F.lit("12x")).otherwise(F.concat(F.nullif(k.cast("string"), F.lit("0")), F.lit("000000000007")))
    rows = orders(spark, sf).select(
        F.when(k % 2 == 0, "ethereum").otherwise("base").alias("chain"), name("0xH", k).alias("hash"), (k % 5).cast("string").alias("logIndex"), F.col("at").cast("string").alias("timeStamp"), name(" 0xA", F.col("c")).alias("from"), name("0xB", F.col("c")).alias("to"), value.alias("value"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("0xC0")).alias("contractAddress"), F.when(k % 3 == 1, "6").otherwise("99").alias("tokenDecimal"), F.when(k % 7 == 0, "1").otherwise("0").alias("isError"),
    )
    return shown(chains.evm(rows))


@query("s12_solana_adapter", f"""WITH x AS (SELECT *, unnest([0, 1]) AS ordinal {FROM} WHERE k % 6 <> 0) SELECT 'solana' AS chain, 'Sig' || k AS tx_hash, ordinal::BIGINT AS ordinal, day AS block_time, 'A' || c AS src, CASE ordinal WHEN 0 THEN 'B' ELSE 'C' END || c AS dst, CASE ordinal WHEN 0 THEN '' ELSE 'Mint' END AS token, CAST(k + ordinal + 1 AS DECIMAL(38,0)) AS amount, CASE ordinal WHEN 0 THEN 9 ELSE 6 END AS decimals FROM x""")
def s12(spark, sf):
    k, c = F.col("k"), F.col("c")
    rows = orders(spark, sf).select(
        name("Sig", k).alias("signature"), F.col("at").alias("timestamp"), F.when(k % 6 == 0, "failed").alias("err"),
        F.array(F.struct(name("A", c).alias("fromUserAccount"), name("B", c).alias("toUserAccount"), (k + 1).alias("amount"))).alias("nativeTransfers"),
        F.array(*(F.struct(name("A", c).alias("fromUserAccount"), to.alias("toUserAccount"), F.lit("Mint").alias("mint"), (k + 2).cast("string").alias("rawAmount"), F.lit(6).alias("decimals")) for to in (name("C", c), name("A", c)))).alias("tokenTransfers"),
    )
    return shown(chains.solana(rows))


@query("s13_tron_adapter", f"""SELECT 'tron' AS chain, 't' || k AS tx_hash, 0::BIGINT AS ordinal, day AS block_time, 'TA' || c AS src, 'Tb' || c AS dst, CASE WHEN k % 2 = 0 THEN '' ELSE 'TR7' END AS token, CAST(k + 1 AS DECIMAL(38,0)) AS amount, CASE WHEN k % 2 = 0 THEN 6 ELSE 18 END AS decimals {FROM} WHERE k % 5 <> 0""")
def s13(spark, sf):
    k, c = F.col("k"), F.col("c")
    info = F.when(k % 2 == 1, F.struct(F.lit("TR7").alias("address"), F.lit(18).alias("decimals")))
    rows = orders(spark, sf).select(name("t", k).alias("transaction_id"), (F.col("at") * 1000 + 999).alias("block_timestamp"), name("TA", c).alias("from"), name("Tb", c).alias("to"), (k + 1).cast("string").alias("value"), info.alias("token_info"), F.when(k % 5 == 0, "Approval").when(k % 5 == 1, "Transfer").alias("type"))
    return shown(chains.tron(rows))


@query("s15_cosmos_adapter", f"""SELECT 'osmosis' AS chain, 'h' || k AS tx_hash, 0::BIGINT AS ordinal, day AS block_time, 'osmo1' || c AS src, 'noble1' || c AS dst, 'uosmo' AS token, CAST(k + 1 AS DECIMAL(38,0)) AS amount, 6 AS decimals {FROM} WHERE k % 4 <> 0""")
def s15(spark, sf):
    k, c = F.col("k"), F.col("c")
    packet = F.to_json(F.struct(name("osmo1", c).alias("sender"), name("noble1", c).alias("receiver"), F.lit("transfer/channel-1/transfer/channel-2/uosmo").alias("denom"), F.when(k % 4 == 0, F.lit("0")).otherwise((k + 1).cast("string")).alias("amount")))
    pair = lambda a, v: F.struct(F.lit(a).alias("key"), v.alias("value"))
    events = F.to_json(F.array(F.struct(F.lit("send_packet").alias("type"), F.array(pair("packet_src_port", F.lit("transfer")), pair("packet_data", packet)).alias("attributes"))))
    return shown(chains.cosmos(orders(spark, sf).select(name("h", k).alias("txhash"), F.col("day").cast("string").alias("timestamp"), F.lit("osmosis").alias("zone"), events.alias("events"))))


@query("s16_ton_adapter", f"""WITH x AS (SELECT *, unnest([0, 2]) AS ordinal {FROM} WHERE k % 8 <> 0) SELECT 'ton' AS chain, 'h' || k AS tx_hash, ordinal::BIGINT AS ordinal, day AS block_time, CASE ordinal WHEN 0 THEN 'EQa' ELSE 'EQb' END || c AS src, CASE ordinal WHEN 0 THEN 'EQb' ELSE 'EQd' END || c AS dst, '' AS token, CAST(k + ordinal + 1 AS DECIMAL(38,0)) AS amount, 9 AS decimals FROM x""")
def s16(spark, sf):
    k, c = F.col("k"), F.col("c")
    message = lambda a, b, v: F.struct(name(a, c).alias("source"), name(b, c).alias("destination"), v.cast("string").alias("value"))
    rows = orders(spark, sf).select(name("h", k).alias("hash"), F.col("at").alias("utime"), message("EQa", "EQb", k + 1).alias("in_msg"), F.array(message("EQb", "EQc", F.lit(0)), message("EQb", "EQd", k + 3)).alias("out_msgs"), F.when(k % 8 == 0, True).alias("aborted"))
    return shown(chains.ton(rows))


@query("s17_stellar_adapter", f"""SELECT 'stellar' AS chain, 'h' || k AS tx_hash, 0::BIGINT AS ordinal, day AS block_time, 'GA' || c AS src, 'GB' || c AS dst, CASE WHEN k % 2 = 0 THEN '' ELSE 'USDC:GISS' END AS token, CAST(k * 10000000 + 5000000 AS DECIMAL(38,0)) AS amount, 7 AS decimals {FROM} WHERE k % 6 NOT IN (0, 1)""")
def s17(spark, sf):
    k, c = F.col("k"), F.col("c")
    rows = orders(spark, sf).select(
        name("h", k).alias("transaction_hash"), F.col("day").cast("string").alias("created_at"), F.when(k % 6 == 0, "create_account").otherwise("payment").alias("type"), F.when(k % 6 == 1, False).alias("transaction_successful"), name("GA", c).alias("from"), name("GB", c).alias("to"), F.concat(k.cast("string"), F.lit(".5")).alias("amount"),
        F.when(k % 2 == 0, "native").otherwise("credit_alphanum4").alias("asset_type"), F.when(k % 2 == 1, "USDC").alias("asset_code"), F.when(k % 2 == 1, "GISS").alias("asset_issuer"),
    )
    return shown(chains.stellar(rows))


@query("s18_sui_adapter", f"""SELECT 'sui' AS chain, 'd' || k AS tx_hash, 0::BIGINT AS ordinal, day AS block_time, CASE k % 4 WHEN 0 THEN 's' WHEN 1 THEN 'p' WHEN 2 THEN 'q' ELSE 's' END || c AS src, 'g' || c AS dst, '0x2::sui::SUI' AS token, CAST(k + 1 AS DECIMAL(38,0)) AS amount, 9 AS decimals {FROM}""")
def s18(spark, sf):
    """Paid by nobody, by another than the sender, by two others (who lost more), and by the sender and another."""
    k, c = F.col("k"), F.col("c")
    change = lambda who, n, coin="0x2::sui::SUI": F.struct(name(who, c).alias("owner"), F.lit(coin).alias("coinType"), n.cast("string").alias("amount"))
    got = change("g", k + 1)
    lost = F.when(k % 4 == 0, F.array(got, change("p", F.lit(-5), "other"))).when(k % 4 == 1, F.array(got, change("p", -k - 1))).when(k % 4 == 2, F.array(got, change("p", F.lit(-3)), change("q", -k - 9))).otherwise(F.array(got, change("p", -k - 9), change("s", F.lit(-2))))
    return shown(chains.sui(orders(spark, sf).select(name("d", k).alias("digest"), (F.col("at") * 1000).alias("timestampMs"), name("s", c).alias("sender"), lost.alias("balanceChanges"))))


@query("s19_aptos_adapter", f"""SELECT 'aptos' AS chain, CAST(k AS VARCHAR) AS tx_hash, 0::BIGINT AS ordinal, day AS block_time, '0xa' || c AS src, '0xb' || c AS dst, 'coin' AS token, CAST(k + 1 AS DECIMAL(38,0)) AS amount, 8 AS decimals {FROM} WHERE k % 4 NOT IN (0, 1)""")
def s19(spark, sf):
    """Every fourth transaction failed, every fourth has two who withdrew."""
    k, c = F.col("k"), F.col("c")
    leg = lambda who, kind, n: F.struct(name(who, c).alias("owner_address"), F.lit("coin").alias("asset_type"), n.alias("amount"), F.lit(f"0x1::fungible_asset::{kind}").alias("type"))
    legs = F.when(k % 4 == 1, F.array(leg("0xa", "Withdraw", k + 1), leg("0xz", "Withdraw", k + 1), leg("0xb", "Deposit", k + 1))).otherwise(F.array(leg("0xa", "Withdraw", k + 1), leg("0xb", "Deposit", k + 1)))
    rows = orders(spark, sf).select(k.alias("transaction_version"), F.col("day").cast("string").alias("transaction_timestamp"), (k % 4 != 0).alias("is_transaction_success"), F.explode(legs).alias("l")).select("transaction_version", "transaction_timestamp", "is_transaction_success", "l.*")
    return shown(chains.aptos(rows))


@query("s20_hyperliquid_adapter", f"""SELECT 'hyperliquid' AS chain, 'h' || k AS tx_hash, 0::BIGINT AS ordinal, day AS block_time, CASE k % 4 WHEN 0 THEN 'hyperliquid:bridge' ELSE '0x' || c END AS src, CASE k % 4 WHEN 0 THEN '0x' || c WHEN 1 THEN 'hyperliquid:bridge' ELSE '0xto' || c END AS dst, 'USDC' AS token, CAST(k * 1000000 + 250000 AS DECIMAL(38,0)) AS amount, 6 AS decimals {FROM} WHERE k % 4 < 3""")
def s20(spark, sf):
    k, c = F.col("k"), F.col("c")
    kind = F.when(k % 4 == 0, "deposit").when(k % 4 == 1, "withdraw").when(k % 4 == 2, "send").otherwise("liquidation")
    rows = orders(spark, sf).select(name("0x", c).alias("user"), (F.col("at") * 1000).alias("time"), name("h", k).alias("hash"), F.struct(kind.alias("type"), F.concat(k.cast("string"), F.lit(".25")).alias("usdc"), name("0xto", c).alias("destination")).alias("delta"))
    return shown(chains.hyperliquid(rows))


@query("s1_chain_dispatch", f"SELECT 'hyperliquid' AS chain, count(*) AS n {FROM} WHERE k % 4 < 3 UNION ALL SELECT 'tron', count(*) {FROM} WHERE k % 5 <> 0")
def s1(spark, sf):
    """Two landing tables by their adapters, scanned by chain."""
    k = F.col("k")
    tron = orders(spark, sf).select(name("t", k).alias("transaction_id"), (F.col("at") * 1000).alias("block_timestamp"), name("TA", F.col("c")).alias("from"), name("Tb", F.col("c")).alias("to"), (k + 1).cast("string").alias("value"), F.lit(None).cast("struct<address: string, decimals: int>").alias("token_info"), F.when(k % 5 == 0, "Approval").alias("type"))
    ledger = orders(spark, sf).select(name("0x", F.col("c")).alias("user"), (F.col("at") * 1000).alias("time"), name("h", k).alias("hash"), F.struct(F.when(k % 4 < 3, "deposit").otherwise("vaultDelta").alias("type"), F.lit("1").alias("usdc"), F.lit("x").alias("destination")).alias("delta"))
    return chains.normalised({"tron": tron, "hyperliquid": ledger}).groupBy("chain").agg(F.count(F.lit(1)).alias("n"))


@query("s8_contract_state", "SELECT c_custkey AS address, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS is_contract FROM customer")
def s8(spark, sf):
    """Two probes of each address: the later one counts unless it failed; a quarter have none that succeeded."""
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("address"))
    turn = F.col("address") % 4
    first = a.select("address", F.when(turn < 3, turn != 1).alias("is_contract"), F.lit(1).alias("probed_at"))
    later = a.select("address", F.when(turn == 0, True).when(turn == 1, False).alias("is_contract"), F.lit(2).alias("probed_at"))
    return chains.contract_state(a, first.union(later))


@query("s9_evidence_receipts", """SELECT '0x' || o_orderkey AS tx_hash, o_orderstatus = 'F' AS succeeded, o_custkey AS block, '0xa' || o_custkey AS src, sha256('{"transaction":{"from":"0xa' || o_custkey || '"},"receipt":{"status":"' || CASE WHEN o_orderstatus = 'F' THEN '0x1' ELSE '0x0' END || '"},"block":{"number":"0x' || lower(printf('%x', o_custkey)) || '"}}') AS sha256 FROM orders WHERE o_orderkey % 2 = 0""")
def s9(spark, sf):
    rows = load(spark, sf, "orders").select(name("0x", F.col("o_orderkey")).alias("tx_hash"), "o_orderkey", F.to_json(F.struct(F.struct(name("0xa", F.col("o_custkey")).alias("from")).alias("transaction"), F.struct(F.when(F.col("o_orderstatus") == "F", "0x1").otherwise("0x0").alias("status")).alias("receipt"), F.struct(F.concat(F.lit("0x"), F.lower(F.hex("o_custkey"))).alias("number")).alias("block"))).alias("body"))
    return chains.receipts(rows.select("tx_hash", "body"), rows.where("o_orderkey % 2 = 0").select("tx_hash")).drop("body")
