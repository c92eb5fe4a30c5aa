"""What can be said of tokens and case records from their own data: risk of a token's contract, tokens
that are sent round as spam, records that are tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Selectors of setBuyTax, setSellTax, setMaxTxAmount, addToBlacklist and isExcludedFromFee.
TRAPS = {"dc1052e2": "setBuyTax", "8cd09d50": "setSellTax", "ec28438a": "setMaxTxAmount", "44337ea1": "addToBlacklist", "5342acb4": "isExcludedFromFee"}
#: What a security service says of a token, and how grave it is.
FLAGS = {"is_honeypot": ("goplus_honeypot", 4), "cannot_sell_all": ("goplus_cannot_sell", 3), "transfer_pausable": ("goplus_pausable", 2), "hidden_owner": ("goplus_hidden_owner", 3), "is_blacklisted": ("goplus_blacklist", 3), "is_proxy": ("goplus_proxy", 1)}


def token_signals(bytecode: Column, buys: Column, sells: Column, pool_removed: Column, flags: dict[str, Column]) -> Column:
    """array<struct(kind, severity)>: traps in the code (any case, 0x or not), purchases without a successful sale (grave
    from 20, serious from 5), a pool that went within a day, and a service's flags ('1' is set)."""
    signal = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    code = F.lower(F.coalesce(bytecode, F.lit("")))
    bought, sold = F.greatest(F.coalesce(buys, F.lit(0)), F.lit(0)), F.coalesce(sells, F.lit(0))
    found = [F.when(F.contains(code, F.lit(s)), signal("bytecode_pattern", 2)) for s in TRAPS]
    found.append(F.when((sold <= 0) & (bought >= 20), signal("high_buy_no_sell", 4)).when((sold <= 0) & (bought >= 5), signal("high_buy_no_sell", 3)).when((sold <= 0) & (bought >= 1), signal("low_volume_no_sell", 2)))
    found.append(F.when(F.coalesce(pool_removed, F.lit(False)), signal("rug_lp_removal", 4)))
    found += [F.when(F.coalesce(flags[name].cast("string") == "1", F.lit(False)), signal(*FLAGS[name])) for name in FLAGS if name in flags]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def token_verdict(signals: Column) -> Column:
    """struct(score 0..10, verdict): one grave signal is a trap or a pulled rug, two serious ones too."""
    of = lambda n: F.size(F.filter(signals, lambda s: s["severity"] == n))
    trap = F.exists(signals, lambda s: (s["severity"] == 4) & s["kind"].isin("high_buy_no_sell", "goplus_honeypot"))
    ladder = [(trap, 10, "honeypot"), (of(4) > 0, 9, "high_risk_rug"), (of(3) >= 2, 7, "high_risk_rug"), (of(3) == 1, 5, "medium_risk"), (of(2) > 0, 3, "low_risk"), (F.size(signals) > 0, 1, "low_risk")]
    row = lambda n, v: F.struct(F.lit(n).alias("score"), F.lit(v).alias("verdict"))
    return reduce(lambda c, step: c.when(step[0], row(step[1], step[2])), ladder[1:], F.when(ladder[0][0], row(ladder[0][1], ladder[0][2]))).otherwise(row(0, "clean"))


SPAM_TRANSFERS = 25
#: What only the symbols of lures hold.
LURES = ("http", "www.", "t.me", "claim", "airdrop", "reward", "voucher", "visit ", ".com", ".net", ".org", ".io", ".xyz", ".app", ".vip", ".cc", ".finance")


def spam_tokens(transfers: DataFrame, keys: list[str], least: int = SPAM_TRANSFERS) -> DataFrame:
    """transfers (contract, symbol, price_id and keys) -> keys, contract of tokens without a price that move ``least`` times or
    more under a key (two at least), or whose symbol is a lure.  The chain's own coin (no contract) and
    priced tokens never are."""
    lure = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce("symbol", F.lit(""))), F.lit(m)) for m in LURES])
    plain = transfers.where("coalesce(contract, '') <> '' AND coalesce(price_id, '') = ''")
    counted = plain.groupBy(*keys, F.lower("contract").alias("contract")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(lure).alias("lure"))
    return counted.where((F.col("n") >= max(2, least)) | F.col("lure")).select(*keys, "contract")


def without_spam(transfers: DataFrame, keys: list[str], least: int = SPAM_TRANSFERS) -> DataFrame:
    """transfers with ``dropped``: whether they are of a spam token under their key."""
    spam = spam_tokens(transfers, keys, least).withColumnRenamed("contract", "spam").withColumn("dropped", F.lit(True))
    rows = transfers.withColumn("spam", F.lower("contract")).join(spam, [*keys, "spam"], "left")
    return rows.drop("spam").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


#: Fixed value: names of victims that mark a test.
TEST_NAME = r"(?i)\btest\b|validation\b|\bbaseline\b|^\s*phase\s+\d|\bsmoke\b|\bfixture\b|\bsample\s+case\b|\bdemo\s+case\b|\bno\s+victim\b"


def case_is_test(victim: Column, has_record: Column) -> Column:
    """Why a case is a test and no investigation; null where it is one."""
    name = F.trim(F.coalesce(victim, F.lit("")))
    return F.when(~has_record, "no victim record").when(name == "", "empty victim name").when(name.rlike(TEST_NAME), "marked as a test")
