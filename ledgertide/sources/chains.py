"""Landing records of each chain, as its public interfaces give them, normalised to one transfers
table: chain, tx_hash, ordinal, block_time, src, dst, token, amount (exact, in whole units of
the smallest part), decimals.

A normaliser keeps only rows that say all of that: a broken amount, a failed transaction or a
missing party drops the row, it is never repaired.  ``normalised`` dispatches by chain; a scan
of one chain is a filter on the partition column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.calldata import ibc_sends

NUMBER = "decimal(38,0)"
COLUMNS = ["chain", "tx_hash", "ordinal", "block_time", "src", "dst", "token", "amount", "decimals"]
#: Decimals of the chains' own coins, and the most that a token may claim.
OWN_DECIMALS = {"ethereum": 18, "solana": 9, "tron": 6, "ton": 9, "stellar": 7, "sui": 9, "aptos": 8, "hyperliquid": 6, "osmosis": 6}
MOST_DECIMALS = 36


def digits(text: Column) -> Column:
    """A string of digits as an exact number; null for anything else, or beyond 38 digits."""
    return F.when(F.trim(text).rlike(r"^\d{1,38}$"), F.trim(text).cast(NUMBER))


def seconds(number: Column) -> Column:
    return F.timestamp_seconds(number.cast("long")).cast("timestamp_ntz")


def whole(df: DataFrame) -> DataFrame:
    """The common columns of the rows that are complete, between two parties, with an amount over zero."""
    kept = df.where("tx_hash <> '' AND src <> '' AND dst <> '' AND src <> dst AND amount > 0 AND block_time IS NOT NULL")
    return kept.select(*COLUMNS[:-1], F.least(F.greatest(F.col("decimals"), F.lit(0)), F.lit(MOST_DECIMALS)).cast("int").alias("decimals"))


def evm(rows: DataFrame) -> DataFrame:
    """(chain, hash, logIndex, timeStamp, from, to, value, contractAddress, tokenDecimal, isError), all text: lists of
    plain, internal and token transfers; a plain one has no contract."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    token = F.coalesce(F.nullif(low("contractAddress"), F.lit("")), F.lit(""))
    places = F.when(token == "", F.lit(18)).otherwise(F.coalesce(F.col("tokenDecimal").try_cast("int"), F.lit(18)))
    good = F.coalesce(F.col("isError"), F.lit("0")) != "1"
    return whole(rows.where(good).select("chain", low("hash").alias("tx_hash"), F.coalesce(F.col("logIndex").try_cast("long"), F.lit(0)).cast("long").alias("ordinal"), seconds(F.col("timeStamp").try_cast("long")).alias("block_time"), low("from").alias("src"), low("to").alias("dst"), token.alias("token"), digits(F.col("value")).alias("amount"), places.alias("decimals")))


def solana(rows: DataFrame) -> DataFrame:
    """(signature, timestamp, err, nativeTransfers array<struct<fromUserAccount, toUserAccount, amount>>, tokenTransfers
    array<struct<fromUserAccount, toUserAccount, mint, rawAmount, decimals>>): parsed transactions, inner
    instructions included; addresses keep their case."""
    native = F.transform(F.coalesce("nativeTransfers", F.array()), lambda t: F.struct(t["fromUserAccount"].alias("src"), t["toUserAccount"].alias("dst"), F.lit("").alias("token"), t["amount"].cast("string").alias("raw"), F.lit(9).alias("decimals")))
    token = F.transform(F.coalesce("tokenTransfers", F.array()), lambda t: F.struct(t["fromUserAccount"].alias("src"), t["toUserAccount"].alias("dst"), t["mint"].alias("token"), t["rawAmount"].alias("raw"), t["decimals"].alias("decimals")))
    every = rows.where("err IS NULL").select("signature", "timestamp", F.posexplode(F.concat(native, token)).alias("ordinal", "t"))
    return whole(every.select(F.lit("solana").alias("chain"), F.col("signature").alias("tx_hash"), F.col("ordinal").cast("long").alias("ordinal"), seconds(F.col("timestamp")).alias("block_time"), "t.src", "t.dst", "t.token", digits(F.col("t.raw")).alias("amount"), "t.decimals"))


def tron(rows: DataFrame) -> DataFrame:
    """(transaction_id, block_timestamp in milliseconds, from, to, value, token_info struct<address, decimals>, type): coin
    transfers have no token; approvals aren't transfers; addresses keep their case."""
    places = F.when(F.col("token_info.address").isNull(), F.lit(6)).otherwise(F.coalesce("token_info.decimals", F.lit(6)))
    kept = rows.where("coalesce(type, 'Transfer') = 'Transfer'")
    return whole(kept.select(F.lit("tron").alias("chain"), F.col("transaction_id").alias("tx_hash"), F.lit(0).cast("long").alias("ordinal"), seconds(F.floor(F.col("block_timestamp") / 1000)).alias("block_time"), F.col("from").alias("src"), F.col("to").alias("dst"), F.coalesce("token_info.address", F.lit("")).alias("token"), digits(F.col("value")).alias("amount"), places.alias("decimals")))


def cosmos(rows: DataFrame) -> DataFrame:
    """(txhash, timestamp, zone, events JSON): outbound token packets; the chain is the zone."""
    sent = rows.select("txhash", "timestamp", "zone", F.posexplode(ibc_sends(F.col("events"), F.col("zone"))).alias("ordinal", "s"))
    return whole(sent.select(F.col("zone").alias("chain"), F.col("txhash").alias("tx_hash"), F.col("ordinal").cast("long").alias("ordinal"), F.col("timestamp").try_cast("timestamp_ntz").alias("block_time"), F.col("s.sender").alias("src"), F.col("s.receiver").alias("dst"), F.col("s.base_denom").alias("token"), digits(F.col("s.amount")).alias("amount"), F.lit(6).alias("decimals")))


def ton(rows: DataFrame) -> DataFrame:
    """(hash, utime, in_msg struct<source, destination, value>, out_msgs array<same>, aborted): each message with a value."""
    every = rows.where("NOT coalesce(aborted, false)").select("hash", "utime", F.posexplode(F.concat(F.array("in_msg"), F.coalesce("out_msgs", F.array()))).alias("ordinal", "m"))
    return whole(every.select(F.lit("ton").alias("chain"), F.col("hash").alias("tx_hash"), F.col("ordinal").cast("long").alias("ordinal"), seconds(F.col("utime")).alias("block_time"), F.col("m.source").alias("src"), F.col("m.destination").alias("dst"), F.lit("").alias("token"), digits(F.col("m.value")).alias("amount"), F.lit(9).alias("decimals")))


def stellar(rows: DataFrame) -> DataFrame:
    """(transaction_hash, created_at, type, transaction_successful, from, to, amount '1.5000000', asset_type, asset_code,
    asset_issuer): successful payments; amounts have seven places."""
    token = F.when(F.col("asset_type") == "native", "").otherwise(F.concat_ws(":", "asset_code", "asset_issuer"))
    raw = F.when(F.col("amount").rlike(r"^\d{1,20}(\.\d{1,7})?$"), (F.col("amount").cast("decimal(30,7)") * 10_000_000).cast(NUMBER))
    paid = rows.where("type = 'payment' AND coalesce(transaction_successful, true)")
    return whole(paid.select(F.lit("stellar").alias("chain"), F.col("transaction_hash").alias("tx_hash"), F.lit(0).cast("long").alias("ordinal"), F.col("created_at").try_cast("timestamp_ntz").alias("block_time"), F.col("from").alias("src"), F.col("to").alias("dst"), token.alias("token"), raw.alias("amount"), F.lit(7).alias("decimals")))


def sui(rows: DataFrame) -> DataFrame:
    """(digest, timestampMs, sender, balanceChanges array<struct<owner, coinType, amount>>): who gained a coin got it from
    the one who lost it; where several did, from the sender if he is one of them, else from who
    lost most; without any from the sender."""
    change = F.transform("balanceChanges", lambda b: F.struct(b["owner"].alias("owner"), b["coinType"].alias("coin"), b["amount"].cast(NUMBER).alias("amount")))
    every = rows.select("digest", "timestampMs", "sender", change.alias("changes")).select("*", F.posexplode("changes").alias("ordinal", "got")).where("got.amount > 0")
    payers = F.array_sort(F.filter("changes", lambda c: (c["coin"] == F.col("got.coin")) & (c["amount"] < 0) & (c["owner"] != F.col("got.owner"))), lambda a, b: F.when(a["amount"] < b["amount"], -1).when(a["amount"] > b["amount"], 1).otherwise(0))
    src = F.when((F.size("payers") == 1) | ((F.size("payers") > 1) & ~F.exists("payers", lambda p: p["owner"] == F.col("sender"))), F.get("payers", F.lit(0))["owner"]).otherwise(F.col("sender"))
    named = every.withColumn("payers", payers)
    return whole(named.select(F.lit("sui").alias("chain"), F.col("digest").alias("tx_hash"), F.col("ordinal").cast("long").alias("ordinal"), seconds(F.floor(F.col("timestampMs") / 1000)).alias("block_time"), src.alias("src"), F.col("got.owner").alias("dst"), F.col("got.coin").alias("token"), F.col("got.amount").alias("amount"), F.lit(9).alias("decimals")))


def aptos(rows: DataFrame) -> DataFrame:
    """(transaction_version, transaction_timestamp, owner_address, asset_type, amount, type, is_transaction_success): activities; a
    deposit comes from the one owner who withdrew the asset in the transaction; where there are
    several or none the row is dropped."""
    kept = rows.where("is_transaction_success AND type RLIKE '(Withdraw|Deposit)'").withColumn("raw", digits(F.col("amount").cast("string")))
    key = ["transaction_version", "asset_type"]
    out = kept.where("type LIKE '%Withdraw%'").groupBy(*key).agg(F.min("owner_address").alias("src"), F.max("owner_address").alias("other")).where("src = other")
    got = kept.where("type LIKE '%Deposit%'").join(out, key)
    return whole(got.select(F.lit("aptos").alias("chain"), F.col("transaction_version").cast("string").alias("tx_hash"), F.lit(0).cast("long").alias("ordinal"), F.col("transaction_timestamp").try_cast("timestamp_ntz").alias("block_time"), "src", F.col("owner_address").alias("dst"), F.col("asset_type").alias("token"), F.col("raw").alias("amount"), F.lit(8).alias("decimals")))


def hyperliquid(rows: DataFrame) -> DataFrame:
    """(user, time in milliseconds, hash, delta struct<type, usdc '12.5', destination>): ledger updates; deposits come from
    the bridge, withdrawals go to it, sends go to their destination."""
    bridge = F.lit("hyperliquid:bridge")
    kind = F.col("delta.type")
    src = F.when(kind == "deposit", bridge).otherwise(F.col("user"))
    dst = F.when(kind == "deposit", F.col("user")).when(kind == "withdraw", bridge).otherwise(F.col("delta.destination"))
    raw = F.when(F.col("delta.usdc").rlike(r"^\d{1,20}(\.\d{1,6})?$"), (F.col("delta.usdc").cast("decimal(30,6)") * 1_000_000).cast(NUMBER))
    moves = rows.where(kind.isin("deposit", "withdraw", "internalTransfer", "send"))
    return whole(moves.select(F.lit("hyperliquid").alias("chain"), F.col("hash").alias("tx_hash"), F.lit(0).cast("long").alias("ordinal"), seconds(F.floor(F.col("time") / 1000)).alias("block_time"), src.alias("src"), dst.alias("dst"), F.lit("USDC").alias("token"), raw.alias("amount"), F.lit(6).alias("decimals")))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"evm": evm, "solana": solana, "tron": tron, "cosmos": cosmos, "ton": ton, "stellar": stellar, "sui": sui, "aptos": aptos, "hyperliquid": hyperliquid}


def normalised(landed: dict[str, DataFrame]) -> DataFrame:
    """Landing tables by adapter -> one transfers table; an adapter that isn't known is an error."""
    unknown = sorted(set(landed) - set(ADAPTERS))
    if unknown:
        raise NotImplementedError(f"no adapter for {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, (ADAPTERS[name](rows) for name, rows in landed.items()))


def contract_state(addresses: DataFrame, facts: DataFrame) -> DataFrame:
    """addresses (address) with is_contract: true, false, or null where no probe succeeded (failed probes
    aren't remembered)."""
    known = facts.where("is_contract IS NOT NULL").groupBy("address").agg(F.max_by("is_contract", "probed_at").alias("is_contract"))
    return addresses.join(known, "address", "left")


def receipts(raw: DataFrame, hashes: DataFrame) -> DataFrame:
    """raw (tx_hash, body JSON of transaction, receipt and block) -> the fields that evidence cites, of the given
    hashes, and the body as it is."""
    path = lambda p: F.get_json_object("body", p)
    found = raw.join(hashes, "tx_hash", "left_semi")
    return found.select("tx_hash", (path("$.receipt.status") == "0x1").alias("succeeded"), F.conv(F.substring(path("$.block.number"), 3, 16), 16, 10).cast("long").alias("block"), path("$.transaction.from").alias("src"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), "body")
