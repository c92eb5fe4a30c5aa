"""Decoders (F): each query writes calls, packets or answers from the mapped tables in their
real layout and reads them back; its SQL says what was put in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgertide.functions import abi
from ledgertide.functions import calldata as C
from ledgertide.functions import expressions as X
from ledgertide.operators.bridge_calls import bridge_destinations
from ledgertide.operators.bundles import ENTRY_POINTS, inner_transfers, user_operations
from ledgertide.operators.joins import position_leads, withdrawals_elsewhere
from ledgertide.plans import encode as E
from ledgertide.plans.domain import load
from ledgertide.plans.registry import query

HEX40 = "lower(lpad(printf('%x', {0}), 40, '0'))"


def word(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 64, "0")


def call(code: str, *parts: Column) -> Column:
    return F.concat(F.lit(code), *parts)


def by_turn(turn: str, cases: list[Column]) -> Column:
    return reduce(lambda c, k: c.when(F.col(turn) == k, cases[k]), range(1, len(cases)), F.when(F.col(turn) == 0, cases[0]))


@query("f10_abi_words", f"""SELECT c_custkey, CASE WHEN c_custkey <> 0 THEN '0x' || {HEX40.format('c_custkey')} END AS address, CAST((c_custkey % 9)::HUGEINT * 1152921504606846976::HUGEINT * 1000 + 10 AS DECIMAL(38,0)) AS amount,
  repeat('f', 64) AS widest, CAST(NULL AS DECIMAL(38,0)) AS unfit FROM customer""")
def f10(spark, sf):
    """Amounts far beyond 64 bits, and a word that no decimal holds."""
    amount = F.lpad(F.concat(F.hex((F.col("c_custkey") % 9) * 1000), F.lit("00000000000000A")), 64, "0")
    made = call("0xa9059cbb", word(F.col("c_custkey")), amount, F.lit("F" * 64))
    data = C.clean(made)
    return load(spark, sf, "customer").select("c_custkey", C.as_address(C.word(data, 0)).alias("address"), C.as_number(C.word(data, 1)).alias("amount"), C.significant(C.word(data, 2)).alias("widest"), C.as_number(C.word(data, 2)).alias("unfit"))


BRIDGES = ["across", "cctp", "hop", "celer", "synapse", "multichain", "wormhole", "optimism_l1", "optimism_l1", "arbitrum_l1", "stargate", "axelar", "across", "unknown"]


@query("f11_bridge_destinations", f"""WITH o AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 14 AS turn, o_orderkey // 14 % 3 AS c FROM orders)
  SELECT o_orderkey, CASE turn WHEN 0 THEN 'depositV3' WHEN 1 THEN 'depositForBurn' WHEN 2 THEN 'sendToL2' WHEN 3 THEN 'sendNative' WHEN 4 THEN 'bridge' WHEN 5 THEN 'anySwapOut' WHEN 6 THEN 'transferTokens'
      WHEN 7 THEN 'depositERC20To' WHEN 8 THEN 'depositETH' WHEN 9 THEN 'outboundTransfer' WHEN 10 THEN 'swapETH' WHEN 11 THEN 'sendToken' WHEN 12 THEN 'depositV3' END AS method,
    CASE WHEN turn IN (0, 2, 3, 4, 5) THEN ['ethereum', 'optimism', 'base'][c + 1] WHEN turn = 1 THEN ['solana', 'base', 'polygon'][c + 1] WHEN turn = 6 THEN ['sui', 'aptos', 'arbitrum'][c + 1] WHEN turn IN (7, 8) THEN 'optimism' WHEN turn = 9 THEN 'arbitrum' WHEN turn = 10 THEN ['avalanche', 'polygon', NULL][c + 1] END AS chain,
    CASE WHEN turn < 8 OR turn IN (9, 10) THEN '0x' || {HEX40.format('k + 1')} END AS address,
    CASE WHEN turn < 11 THEN 'medium' WHEN turn < 13 THEN 'low' END AS confidence, turn = 8 AS to_sender FROM o WHERE turn < 13
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM o WHERE turn = 13""")
def f11(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 1).alias("k"), (F.col("o_orderkey") % 14).alias("turn"), F.floor(F.col("o_orderkey") / 14).alias("part"))
    rows = rows.withColumn("c", F.col("part") % 3)
    to, zero, five = word(F.col("k")), word(F.lit(0)), word(F.lit(5))
    number = lambda *ids: word(F.element_at(F.array(*(F.lit(i) for i in ids)), (F.col("c") + 1).cast("int")))
    evm = number(1, 10, 8453)
    pointed = F.concat(number(106, 109, 999), zero, word(F.lit(160)), five, five, word(F.lit(20)), F.right(to, F.lit(40)), F.lit("0" * 24))
    made = [
        call("0x7b939232", five, to, five, five, five, five, evm), call("0x6fd3504e", five, number(5, 6, 7), to, five), call("0xdeace8f5", evm, to, five, five, five, five, five),
        call("0x3f2e5fc3", to, five, evm, five, five), call("0xfa9d8e22", to, evm), call("0x241dc2df", five, to, five, evm), call("0x0f5287b0", five, five, number(21, 22, 23), to, five, five),
        call("0x838b2520", five, five, to), call("0xb1a1a882", five), call("0xd2ce7d65", five, to), call("0x1114cd2a", pointed), call("0x26ef699d", five), call("0x7b939232", to, to), call("0xffffffff", to),
    ]
    protocol = by_turn("turn", [F.lit(x) for x in BRIDGES])
    return bridge_destinations(rows.select("o_orderkey", protocol.alias("protocol"), F.upper(by_turn("turn", made)).alias("calldata")))


# Public transactions, as they stand on chain: a swap to bitcoin by memo, and an order to ethereum.
ON_CHAIN_SWAP = (
    "0x44bc937b00000000000000000000000082a5cf67f3e6970c0529122178075c0a94878bda0000000000000000000000000000000000000000000000000000000000000000000000000000"
    "000000000000000000000000000000000000009a977ac75ce80000000000000000000000000000000000000000000000000000000000000000a00000000000000000000000000000000000"
    "00000000000000000000006a064cc1000000000000000000000000000000000000000000000000000000000000003b3d3a4254432e4254433a626331713877327970716778333967756378"
    "6379707176326d3930777a397276686d6d72636e70646a733a3131373736300000000000"
)
ON_CHAIN_ORDER = (
    "0xb930370100000000000000000000000000000000000000000000000000000000000000c000000000000000000000000000000000000000000000000000000199c733ef01000000000000"
    "000000000000000000000000000000000000000000000000036000000000000000000000000000000000000000000000000000000000000012f20000000000000000000000000000000000"
    "00000000000000000000000000038000000000000000000000000000000000000000000000000000000000000003a0000000000000000000000000af88d065e77c8cc2239327c5edb3a432"
    "268e5831000000000000000000000000000000000000000000000000000002a8ece3d6c7000000000000000000000000000000000000000000000000000000000000016000000000000000"
    "0000000000000000000000000000026a4e6c4b96d83604e8000000000000000000000000000000000000000000000000000000000000000001000000000000000000000000000000000000"
    "00000000000000000000000001a0000000000000000000000000f4be227b268e191b79097daad0acccd9a7a7fad20000000000000000000000000000000000000000000000000000000000"
    "0001e0000000000000000000000000000000000000000000000000000000000000022000000000000000000000000000000000000000000000000000000000000002600000000000000000"
    "00000000000000000000000000000000000000000000028000000000000000000000000000000000000000000000000000000000000000146b175474e89094c44da98b954eedeac495271d"
    "0f0000000000000000000000000000000000000000000000000000000000000000000000000000000000000014c1ee32fac1d9a0ce63021467e34164df3078289b00000000000000000000"
    "00000000000000000000000000000000000000000000000000000000000000000014f4be227b268e191b79097daad0acccd9a7a7fad2000000000000000000000000000000000000000000"
    "0000000000000000000000000000000000000000000014555ce236c0220695b68341bc48c68d52210cc35b0000000000000000000000000000000000000000000000000000000000000000"
    "000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000"
    "00000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000420101010000493f5c0000"
    "00000000000000000000000000000000e80436d8964b6c4e6a0200000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000"
    "0000000000000000000000"
)
#: Accounts in Base58 and their bytes: a token program, wrapped SOL, a dollar token.
BASE58_ACCOUNTS = {
    "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA": "06ddf6e1d765a193d9cbe146ceeb79ac1cb485ed5f5b37913a8cf5857eff00a9",
    "So11111111111111111111111111111111111111112": "069b8857feab8184fb687f634618c035dac439dc1aeb3b5598a0f00000000001",
    "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v": "c6fa7af3bedbad3a3d65f36aabc97431b1bbe4c2d2f6e0e47ca60203452f5d61",
}


@query("f11_dynamic_calls", f"""WITH o AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 15 AS turn, o_orderkey // 15 % 3 AS c FROM orders),
  d AS (SELECT *, '0x' || {HEX40.format('k + 1')} AS evm, ['ethereum', 'optimism', 'base'][c + 1] AS chain3 FROM o)
  SELECT o_orderkey, ['depositWithExpiry', 'deposit', 'depositWithExpiry', 'startBridgeTokensViaStargate', 'send_v1', 'send_v2', 'sendToken_v2', 'createSaltedOrder', 'sendToken', 'bridgeCall', 'metaRoute', 'ccipSend', 'transferTokens', 'depositWithExpiry', 'createSaltedOrder'][turn + 1] AS method,
    CASE turn WHEN 0 THEN 'bitcoin' WHEN 1 THEN 'doge' WHEN 2 THEN NULL WHEN 4 THEN ['ethereum', 'bsc', 'linea'][c + 1] WHEN 5 THEN ['scroll', 'bsc', 'zksync'][c + 1] WHEN 6 THEN ['linea', 'bsc', 'fantom'][c + 1] WHEN 8 THEN ['bsc', 'cosmos', 'secret'][c + 1] WHEN 9 THEN 'polygon'
      WHEN 11 THEN ['base', 'arbitrum', NULL][c + 1] WHEN 12 THEN 'solana' WHEN 13 THEN 'bitcoin' WHEN 14 THEN 'ethereum' ELSE chain3 END AS chain,
    CASE turn WHEN 0 THEN 'bc1q' || lpad(CAST(k AS VARCHAR), 38, '0') WHEN 1 THEN 'D' || lpad(CAST(k AS VARCHAR), 33, 'x') WHEN 2 THEN NULL WHEN 9 THEN 'osmo1' || lpad(CAST(k AS VARCHAR), 38, 'q') WHEN 12 THEN ['TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA', 'So11111111111111111111111111111111111111112', 'EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v'][c + 1]
      WHEN 13 THEN 'bc1q8w2ypqgx39gucxcypqv2m90wz9rvhmmrcnpdjs' WHEN 14 THEN '0xc1ee32fac1d9a0ce63021467e34164df3078289b' ELSE evm END AS address,
    CASE WHEN turn = 2 THEN 'low' ELSE 'medium' END AS confidence, false AS to_sender FROM d""")
def f11_dynamic(spark, sf):
    """Calls whose recipients stand in strings, byte arrays and tuples, written for each order in
    their real layout; the last two kinds are public transactions as they are."""
    rows = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 15).alias("turn"), (F.floor(F.col("o_orderkey") / 15) % 3).alias("c"))
    key = F.col("k").cast("string")
    to, five = E.word(F.col("k") + 1), E.static(E.word(5))
    twenty = F.right(to, F.lit(40))
    pick = lambda *values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("c") + 1).cast("int"))
    number = lambda *ids: E.static(F.lpad(pick(*(f"{i:x}" for i in ids)), 64, "0"))
    evm, nothing = number(1, 10, 8453), E.data(F.lit(""), 0)
    memo = lambda text, size: E.words_of(text, size)
    swap = memo(F.concat(F.lit("=:BTC.BTC:bc1q"), F.lpad(key, 38, "0"), F.lit(":0/1/0")), 58)
    made = [
        E.call("0x44bc937b", five, five, five, swap, five),
        E.call("0x1fece7b4", five, five, five, memo(F.concat(F.lit("SWAP:DOGE.DOGE:D"), F.lpad(key, 33, "x")), 49)),
        E.call("0x44bc937b", five, five, five, memo(F.lit("a memo without a grammar"), 24), five),
        E.call("0xed178619", E.several(five, memo(F.lit("stargate"), 8), memo(F.lit("someone"), 7), five, five, E.static(to), five, evm, five, five), E.several(five, five, nothing)),
        E.call("0xc5803100", number(101, 102, 195), E.data(F.concat(twenty, F.lit("ab" * 20)), 40), E.data(F.lit("cd" * 70), 70), five, five, nothing),
        E.call("0x2637a450", E.several(number(30214, 30102, 30253), E.static(to), E.data(F.lit("ef" * 3), 3), nothing, five), five),
        E.call("0xcbef2aa9", E.several(number(30183, 30102, 112), E.static(to), five, five, nothing, nothing, nothing), five, five, five),
        E.call("0xb9303701", E.several(five, five, E.data(F.lit("6b" * 20), 20), five, evm, E.data(twenty, 20), five, E.data(twenty, 20), nothing, nothing, nothing), five, nothing, five, nothing, nothing),
        E.call("0x26ef699d", E.words_of(pick("binance", "Osmosis", "secret "), 7), E.words_of(F.concat(F.lit("0x"), twenty), 42), memo(F.lit("aUSDC"), 5), five),
        E.call("0x84d2bb4d", E.words_of(F.lit("Polygon"), 7), E.words_of(F.concat(F.lit("osmo1"), F.lpad(key, 38, "q")), 43), nothing, five),
        E.call("0xa11b1198", E.several(nothing, nothing, E.array(five), five, five, five, five, E.static(to), E.data(F.concat(F.lit("ce654c17"), E.word(5), E.word(6), evm[1], E.word(7)), 132))),
        E.call("0x96f4e9f9", number(15971525489660198786, 4949039107694359620, 77), E.several(E.data(to, 32), nothing, E.array(), five, nothing)),
        E.call("0x0f5287b0", five, five, number(1, 1, 1), E.static(pick(*BASE58_ACCOUNTS.values())), five, five),
        (F.lit(ON_CHAIN_SWAP), 0),
        (F.lit(ON_CHAIN_ORDER), 0),
    ]
    names = ["THORChain Router", "thorchain", "thorchain", "LI.FI Diamond", "LayerZero Endpoint", "layerzero", "Stargate", "deBridge DLN Source", "Axelar Gateway", "Squid Router", "symbiosis", "Chainlink CCIP", "Wormhole Token Bridge", "THORChain Router", "deBridge DLN Source"]
    return bridge_destinations(rows.select("o_orderkey", by_turn("turn", [F.lit(n) for n in names]).alias("protocol"), by_turn("turn", [c for c, _ in made]).alias("calldata")))


MOST = 2**256 - 1


def spread(rows):
    """Narrow rows dealt over all cores, before each becomes kilobytes of calls or logs."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "o_orderkey")


def bundles(spark, sf):
    """tx, to, calldata of a bundle of six operations in each order: a token transfer inside execute, execute's own
    value, a bare transfer of the largest amount, both forms of executeBatch, and one whose calldata is cut
    off.  Every fifth goes elsewhere; every seventh claims more operations than it has."""
    k = F.col("o_custkey")
    address = lambda n: E.static(E.word(k + n))
    transfer = lambda to, amount: E.call("a9059cbb", address(to), E.static(amount))
    taken = E.call("23b872dd", address(20), address(21), E.static(E.word(k)))
    amount, none = E.word(k * 1000), E.static(E.word(0))
    calls = [
        E.call("b61d27f6", address(2), none, E.data(*transfer(3, amount))),
        E.call("b61d27f6", address(3), E.static(E.word(77)), E.data(F.lit(""), 0)),
        transfer(4, F.lit("f" * 64)),
        E.call("18dfb3c7", E.array(address(5), address(6)), E.array(E.data(*transfer(7, amount)), E.data(*transfer(8, amount)))),
        E.call("47e1da2a", E.array(address(9), address(10), address(11)), E.array(none, E.static(E.word(78)), none), E.array(E.data(*taken), E.data(F.lit(""), 0), E.data(F.lit(""), 0))),
    ]
    head = lambda body: E.several(address(1), none, E.data(F.lit(""), 0), body, *[none] * 5, E.data(F.lit(""), 0), E.data(F.lit(""), 0))
    broken = E.several(address(1), none, E.data(F.lit(""), 0), E.static(E.word(10**6)), *[none] * 5, E.data(F.lit(""), 0), E.data(F.lit(""), 0))
    bundle, _ = E.call("0x1fad948c", E.array(*(head(E.data(*c)) for c in calls), broken), address(30))
    bundle = F.when(F.col("o_orderkey") % 7 == 3, F.overlay(bundle, E.word(3000), 10 + 128 + 1)).otherwise(bundle)
    to = F.when(F.col("o_orderkey") % 5 == 0, F.lit("0x" + "12" * 20)).otherwise(F.lit(ENTRY_POINTS[0]))
    return spread(load(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(F.col("o_orderkey").alias("tx"), to.alias("to"), bundle.alias("calldata"))


@query("f12_user_operations", f"""WITH o AS (SELECT o_orderkey AS tx, o_custkey AS k FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 3),
  moved AS (SELECT *, unnest([[0, 0, 1, 3, 2], [1, 0, 1, 3, -1], [2, 0, 1, 4, -1], [3, 0, 1, 7, 5], [3, 1, 1, 8, 6], [4, 0, 20, 21, 9], [4, 1, 1, 10, -1]]) AS m FROM o)
  SELECT tx, CAST(m[1] AS INTEGER) AS index, CAST(m[2] AS INTEGER) AS place, '0x' || {HEX40.format('k + m[3]')} AS src, '0x' || {HEX40.format('k + m[4]')} AS dst, CASE WHEN m[5] > 0 THEN '0x' || {HEX40.format('k + m[5]')} ELSE '' END AS token,
    CASE WHEN m[1] = 1 THEN '77' WHEN m[1] = 2 THEN '{MOST}' WHEN m[3] = 20 THEN CAST(k AS VARCHAR) WHEN m[1] = 4 THEN '78' ELSE CAST(k * 1000 AS VARCHAR) END AS amount FROM moved""")
def f12(spark, sf):
    found = user_operations(bundles(spark, sf)).where("problem IS NULL")
    return inner_transfers(found.select("tx", "index", "sender", "call"))


@query("f12_bundle_problems", """SELECT o_orderkey AS tx, CASE WHEN o_orderkey % 7 <> 3 THEN 5 END AS index, CASE WHEN o_orderkey % 7 = 3 THEN 3000 ELSE 6 END::BIGINT AS n_declared, CASE WHEN o_orderkey % 7 = 3 THEN 'count' ELSE 'operation' END AS problem
  FROM orders WHERE o_orderkey % 5 <> 0""")
def f12_problems(spark, sf):
    """What a bundle holds and couldn't be read."""
    return user_operations(bundles(spark, sf)).where("problem IS NOT NULL").select("tx", "index", "n_declared", "problem")


@query("f13_safe_owner_changes", f"""SELECT o_orderkey, ['swapOwner', 'addOwnerWithThreshold', 'removeOwner', 'changeThreshold'][o_orderkey % 5 + 1] AS method, CASE WHEN o_orderkey % 5 IN (0, 2) THEN '0x' || {HEX40.format('o_custkey + 1')} END AS prev_owner,
  CASE WHEN o_orderkey % 5 IN (0, 2) THEN '0x' || {HEX40.format('o_custkey + 2')} END AS old_owner, CASE o_orderkey % 5 WHEN 0 THEN '0x' || {HEX40.format('o_custkey + 3')} WHEN 1 THEN '0x' || {HEX40.format('o_custkey + 1')} END AS new_owner,
  CASE WHEN o_orderkey % 5 IN (1, 2) THEN 3::BIGINT WHEN o_orderkey % 5 = 3 THEN o_custkey + 1 END AS threshold FROM orders WHERE o_orderkey % 5 < 4""")
def f13(spark, sf):
    a, b, c = (word(F.col("o_custkey") + n) for n in (1, 2, 3))
    three = word(F.lit(3))
    made = [call("0xe318b52b", a, b, c), call("0x0d582f13", a, three), call("0xf8dc5dd9", a, b, three), call("0x694e80c3", a), call("0xa9059cbb", a, b)]
    rows = load(spark, sf, "orders").withColumn("turn", F.col("o_orderkey") % 5)
    calls = rows.select("o_orderkey", by_turn("turn", made).alias("calldata"))
    return calls.select("o_orderkey", F.explode(F.array(C.safe_change(F.col("calldata")))).alias("s")).where("s IS NOT NULL").select("o_orderkey", "s.*")


@query("f14_wrap_events", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'unwrap' ELSE 'wrap' END AS direction, CAST(CASE o_orderkey % 4 WHEN 1 THEN o_custkey + 1 ELSE o_custkey * 2 + 1 END AS DECIMAL(38,0)) AS amount, CASE WHEN o_orderkey % 4 = 3 THEN 'WETH' ELSE 'ETH' END AS spent
  FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 3 < 2""")
def f14(spark, sf):
    wrappers = spark.createDataFrame([("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", "ETH", "WETH")], "wrapper string, native string, wrapped string")  # fixed value
    rows = load(spark, sf, "orders").withColumn("turn", F.col("o_orderkey") % 4).withColumn("wrapper", F.when(F.col("o_orderkey") % 3 < 2, F.lit("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2")).otherwise(F.lit("0x" + "ab" * 20)))
    n = word(F.col("o_custkey") * 2 + 1)
    made = by_turn("turn", [call("0xa9059cbb", n, n), F.lit("0xd0e30db0"), call("0xea598cb0", n), call("0x2e1a7d4d", n)])
    value = F.when(F.col("turn") == 1, F.col("o_custkey") + 1).otherwise(F.lit(0))
    found = rows.join(F.broadcast(wrappers), "wrapper").select("o_orderkey", "native", "wrapped", F.explode(F.array(C.wrap_event(made, value))).alias("w")).where("w IS NOT NULL")
    return found.select("o_orderkey", "w.direction", "w.amount", F.when(F.col("w.direction") == "wrap", F.col("native")).otherwise(F.col("wrapped")).alias("spent"))


@query("f15_ibc_sends", """SELECT o_orderkey, 'osmo1' || o_custkey AS sender, 'noble1' || o_custkey AS receiver, 'uusdc' AS base_denom, CAST(o_custkey + 1 AS VARCHAR) AS amount, CAST(o_orderkey AS VARCHAR) AS sequence, CASE o_orderkey % 4 WHEN 0 THEN 'noble' WHEN 1 THEN 'cosmoshub' END AS dest_chain, true AS freezable
  FROM orders WHERE o_orderkey % 4 < 3""")
def f15(spark, sf):
    packet = F.to_json(F.struct(F.concat(F.lit("osmo1"), F.col("o_custkey")).alias("sender"), F.concat(F.lit("noble1"), F.col("o_custkey")).alias("receiver"), F.lit("transfer/channel-750/uusdc").alias("denom"), F.when(F.col("o_orderkey") % 4 == 3, F.lit("0")).otherwise((F.col("o_custkey") + 1).cast("string")).alias("amount")))
    channel = F.when(F.col("o_orderkey") % 4 == 0, "channel-750").when(F.col("o_orderkey") % 4 == 1, "channel-0").otherwise("channel-9")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    port = lambda p: F.array(pair("packet_data", packet), pair("packet_src_port", F.lit(p)), pair("packet_src_channel", channel), pair("packet_dst_channel", F.lit("channel-1")), pair("packet_sequence", F.col("o_orderkey")))
    event = lambda kind, p: F.struct(F.lit(kind).alias("type"), port(p).alias("attributes"))
    events = F.to_json(F.array(event("message", "transfer"), event("send_packet", "transfer"), event("send_packet", "icahost")))
    found = load(spark, sf, "orders").select("o_orderkey", F.explode(C.ibc_sends(events, F.lit("osmosis"))).alias("s"))
    return found.select("o_orderkey", *(f"s.{c}" for c in ("sender", "receiver", "base_denom", "amount", "sequence", "dest_chain", "freezable")))


@query("f5_maker_destination", """WITH o AS (SELECT o_orderkey, 9000 + o_custkey % 40 AS tail FROM orders) SELECT o_orderkey, CAST(tail - 9000 AS INTEGER) AS code, CASE tail - 9000 WHEN 1 THEN 'ethereum' WHEN 2 THEN 'arbitrum' WHEN 3 THEN 'zksync' WHEN 5 THEN 'ethereum' WHEN 6 THEN 'polygon' WHEN 7 THEN 'optimism' WHEN 10 THEN 'metis'
  WHEN 14 THEN 'zksync' WHEN 15 THEN 'bsc' WHEN 17 THEN 'polygon_zkevm' WHEN 19 THEN 'scroll' WHEN 21 THEN 'base' WHEN 23 THEN 'linea' WHEN 31 THEN 'manta' END AS chain FROM o WHERE tail > 9000 AND o_orderkey % 3 > 0""")
def f5(spark, sf):
    tail = (F.col("o_custkey") % 40 + 9000).cast("string")
    # plain chains end in the code; on zkSync Lite it ends the first eleven digits; a third of the amounts have none
    amount = by_turn("turn", [F.lit("1234567890001234"), F.concat((F.col("o_orderkey") + 10).cast("string"), F.lit("0000"), tail), F.concat(F.lit("1234567"), tail, F.lit("000"))])
    source = by_turn("turn", [F.lit("ethereum"), F.lit("base"), F.lit("zksync_lite")])
    rows = load(spark, sf, "orders").withColumn("turn", F.col("o_orderkey") % 3)
    return rows.select("o_orderkey", C.maker_destination(amount, source).alias("d")).where("d IS NOT NULL").select("o_orderkey", "d.*")


@query("f21_reply_classes", """WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS turn, CAST(o_custkey + 0.25 AS DECIMAL(20,2)) AS usd FROM orders)
  SELECT o_orderkey, ['full_freeze', 'acknowledged', 'returned_to_victim', 'partial_freeze', 'declined', 'acknowledged', 'acknowledged', 'partial_freeze', 'acknowledged'][turn + 1] AS outcome, CASE WHEN turn IN (1, 6, 8) THEN 'low' ELSE 'high' END AS confidence,
    CASE WHEN turn IN (0, 7) THEN CAST(usd AS DOUBLE) WHEN turn = 3 THEN 9999.5 END AS frozen_usd, CASE WHEN turn = 2 THEN CAST(usd AS DOUBLE) END AS returned_usd, turn IN (0, 2, 3, 4, 7) AS review FROM o""")
def f21(spark, sf):
    usd = F.format_number((F.col("o_custkey") + 0.25).cast("decimal(20,2)"), 2)
    texts = [
        F.concat(F.lit("Of the $300,000 stolen, we HAVE FROZEN $"), usd, F.lit(" at once.")), F.lit("We have not returned any of the $500."), F.concat(F.lit("The funds were returned to the victim: $ "), usd), F.lit("$1 is lost; a portion of it is on hold, $9,999.50."),
        F.lit("We are unable to assist without a court order."), F.lit("Your matter is under review."), F.lit("  "), F.concat(F.lit("We have frozen $"), usd, F.lit(" but are unable to freeze the rest, $12.")), F.lit("Hello."),
    ]
    rows = load(spark, sf, "orders").withColumn("turn", F.col("o_orderkey") % 9)
    found = rows.select("o_orderkey", X.reply_class(by_turn("turn", texts)).alias("r")).select("o_orderkey", "r.*")
    return found.withColumn("frozen_usd", F.col("frozen_usd").cast("double")).withColumn("returned_usd", F.col("returned_usd").cast("double"))


@query("f25_canonical_json", r"""SELECT c_custkey, sha256('{"alpha":' || c_custkey || ',"name":"' || c_name || '","z\u00e9":[1,"a"]}') AS hash FROM customer""")
def f25(spark, sf):
    """Fields come in an order that depends on the row; the object's names are sorted, non-ASCII is escaped."""
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    fields = [entry("zé", F.lit('[1,"a"]')), entry("name", F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))), entry("alpha", F.col("c_custkey").cast("string"))]
    either = F.when(F.col("c_custkey") % 2 == 0, F.array(*fields)).otherwise(F.array(*fields[::-1]))
    return load(spark, sf, "customer").select("c_custkey", F.sha2(X.canonical_json(F.map_from_entries(either)).cast("binary"), 256).alias("hash"))


@query("f27_finite_money", """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN CAST(value AS DOUBLE) END AS usd FROM events""")
def f27(spark, sf):
    odd = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 6 == 3, F.lit(float("-inf"))).when(F.col("event_id") % 3 == 1, F.col("value").cast("double"))
    return load(spark, sf, "events").select("event_id", X.finite(odd).alias("usd"))


@query("p12_zero_amounts", "SELECT o_orderkey % 7 < 3 AS pruned, count(*) AS n FROM orders GROUP BY ALL")
def p12(spark, sf):
    """Amounts that are exactly zero go; blank, null and unreadable ones stay."""
    raw = by_turn("turn", [F.lit("0"), F.lit(" 0x000 "), F.lit("-0.00"), F.lit(""), F.lit(None).cast("string"), F.lit("zero"), F.concat(F.lit("0x0"), F.hex("o_orderkey"))])
    rows = load(spark, sf, "orders").withColumn("turn", F.col("o_orderkey") % 7)
    return rows.groupBy(X.amount_is_zero(raw).alias("pruned")).agg(F.count(F.lit(1)).alias("n"))


POSITION_MANAGER = "0xc36442b4a4522e871399cd717abdd847ab11fe88"


@query("f16_position_leads", f"""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'lp' WHEN 1 THEN 'lending' ELSE 'vault' END AS kind, o_orderkey AS park_tx, o_orderkey * 10 + l_linenumber AS exit_tx, '0x' || {HEX40.format('o_custkey + 1')} AS parker,
  '0x' || {HEX40.format('CASE WHEN l_linenumber % 2 = 1 THEN o_custkey ELSE l_suppkey END + 1')} AS recipient, CAST(l_partkey AS DOUBLE) AS amount0, CASE WHEN o_orderkey % 3 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS amount1,
  l_linenumber % 2 = 1 OR l_suppkey = o_custkey AS recipient_is_parker, 'high' AS link, CASE WHEN l_linenumber % 2 = 1 OR l_suppkey = o_custkey THEN 'high' ELSE 'medium' END AS actor
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber >= 2 AND l_suppkey % 5 <> 0""")
def f16(spark, sf):
    """An order parks value in block 2, its lines take some out in the block of their number; every
    fifth supplier's lines are logs of another contract."""
    orders = spread(load(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("turn")))
    topic = lambda code, *parts: F.array(F.lit(code), *(F.concat(F.lit("0x"), p) for p in parts))
    codes = [e[2] for e in C.POSITION_EVENTS if e[0] != "market"]
    nothing, order, owner = word(F.lit(0)), word(F.col("o_orderkey")), word(F.col("o_custkey") + 1)
    logs = lambda contract, block, tx, log, topics, data: [F.lit("ethereum").alias("chain"), contract.alias("contract"), block.alias("block"), tx.alias("tx"), log.alias("log"), by_turn("turn", topics).alias("topics"), F.concat(F.lit("0x"), by_turn("turn", data)).alias("data")]
    value = word(F.lit(7))
    parks = orders.select(*logs(F.lit(POSITION_MANAGER), F.lit(2), F.col("o_orderkey"), F.lit(0), [topic(codes[0], order), topic(codes[2], order, owner, nothing), topic(codes[4], owner, order)], [F.concat(value, value, value), F.concat(owner, value), F.concat(value, value)]))
    lines = spread(orders.join(load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "turn", "l_linenumber", "l_suppkey", "l_partkey"))
    to = word(F.when(F.col("l_linenumber") % 2 == 1, F.col("o_custkey")).otherwise(F.col("l_suppkey")) + 1)
    part, number = word(F.col("l_partkey")), word(F.col("l_linenumber"))
    contract = F.when(F.col("l_suppkey") % 5 == 0, "0x" + "ab" * 20).otherwise(POSITION_MANAGER)
    exits = lines.select(*logs(contract, F.col("l_linenumber"), F.col("o_orderkey") * 10 + F.col("l_linenumber"), F.lit(1), [topic(codes[1], order), topic(codes[3], order, owner, to), topic(codes[5], order, to, order)], [F.concat(to, part, number), part, F.concat(part, part)]))
    parker = F.concat(F.lit("0x"), F.right(owner, F.lit(40)))
    found = position_leads(C.position_events(parks.unionByName(exits), [POSITION_MANAGER]), orders.select(F.lit("ethereum").alias("chain"), F.col("o_orderkey").alias("tx"), parker.alias("parker")))
    return found.select("kind", "park_tx", "exit_tx", "parker", "recipient", F.col("amount0").cast("double").alias("amount0"), F.col("amount1").cast("double").alias("amount1"), "recipient_is_parker", "link", "actor")


MARKET = "0xc3d688b66703497daa19211eedff47f25384cdc3"
LENDING_EXIT, MARKET_EXIT = (e[2] for e in C.POSITION_EVENTS if e[0] in ("lending", "market") and e[1] == "exit")


@query("f16_withdrawals_elsewhere", f"""SELECT l_orderkey AS tx, l_linenumber AS log, CASE WHEN l_linenumber % 2 = 0 THEN 'lending' ELSE 'market' END AS kind, '0x' || {HEX40.format('o_custkey + 1')} AS wallet, '0x' || {HEX40.format('l_suppkey + 1')} AS recipient,
    CASE WHEN l_linenumber = 4 THEN '{MOST}' ELSE CAST(l_partkey AS VARCHAR) END AS amount, 'high' AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey AND o_custkey % 4 <> 0 AND (l_linenumber % 2 = 0 OR l_suppkey % 5 <> 0)""")
def f16_elsewhere(spark, sf):
    """Each line is a withdrawal by its order's customer to its supplier, from a pool or a market; every fifth
    supplier's come from a contract that only shares the market's event; every fourth wallet isn't traced."""
    rows = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    owner, to, zero = (F.concat(F.lit("0x"), w) for w in (E.word(F.col("o_custkey") + 1), E.word(F.col("l_suppkey") + 1), E.word(9)))
    pool = F.col("l_linenumber") % 2 == 0
    topics = F.when(pool, F.array(F.lit(LENDING_EXIT), zero, owner, to)).otherwise(F.array(F.lit(MARKET_EXIT), owner, to))
    contract = F.when(pool | (F.col("l_suppkey") % 5 != 0), F.lit(MARKET)).otherwise(F.lit("0x" + "ab" * 20))
    data = F.concat(F.lit("0x"), F.when(F.col("l_linenumber") == 4, F.lit("f" * 64)).otherwise(E.word(F.col("l_partkey"))))
    logs = rows.select(F.lit("ethereum").alias("chain"), contract.alias("contract"), F.lit(1).alias("block"), F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("log"), topics.alias("topics"), data.alias("data"))
    wallets = load(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.lit("ethereum").alias("chain"), F.concat(F.lit("0x"), F.right(E.word(F.col("c_custkey") + 1), F.lit(40))).alias("wallet"))
    found = withdrawals_elsewhere(C.position_events(logs, [], [MARKET]), wallets)
    return found.select("tx", "log", "kind", "wallet", "recipient", "amount", "confidence")


@query("f10_wide_sums", f"""SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) FILTER (WHERE o_orderkey % 3 = 0) = 0 THEN '' ELSE CAST(count(*) FILTER (WHERE o_orderkey % 3 = 0) * 1000000007::HUGEINT AS VARCHAR) || repeat('0', 60) END AS total
  FROM orders GROUP BY o_custkey""")
def f10_wide(spark, sf):
    """Exact sums of words far beyond 128 bits: a third of a customer's calls move 1000000007 * 10**60, the others nothing."""
    unit = f"{1000000007 * 10**60:064x}"
    data = abi.raw(F.concat(F.lit("0xa9059cbb"), E.word(F.col("o_custkey")), F.when(F.col("o_orderkey") % 3 == 0, F.lit(unit)).otherwise(F.lit("0" * 64))))
    rows = load(spark, sf, "orders").select("o_custkey", data.alias("data")).select("o_custkey", abi.limbs(abi.slot(F.col("data"), abi.ARGUMENTS, 1)).alias("amount"))
    sums = rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), *abi.limb_sums(F.col("amount")))
    return sums.select("o_custkey", "n", F.when(abi.summed() == "0", "").otherwise(abi.summed()).alias("total"))
