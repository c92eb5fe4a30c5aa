"""Decoders of contract calls over hexadecimal calldata, all of built-in expressions.

A call is 0x, a selector of 8 digits and words of 64.  A word is an address only if its
twelve leading bytes are zero and the rest isn't, so that a misread slot never makes one up.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import abi

NUMBER = "decimal(38,0)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written, and computed, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(calldata: Column) -> Column:
    """Trimmed, in lower case, with 0x; null unless it is a selector and hexadecimal digits."""
    bare = F.regexp_replace(F.lower(F.trim(calldata)), "^0x", "")
    return F.concat(F.lit("0x"), F.nullif(F.regexp_extract(bare, "^[0-9a-f]{8,}$", 0), F.lit("")))


def selector(data: Column) -> Column:
    return F.substring(data, 1, 10)


def word(data: Column, slot: int | Column) -> Column:
    """The slot's 64 digits; null beyond the end."""
    at = F.substring(data, 11 + 64 * slot, 64) if isinstance(slot, int) else F.substring(data, 11 + 64 * slot, F.lit(64))
    return F.when(F.length(at) == 64, at)


def as_address(digits: Column) -> Column:
    return F.when(digits.rlike("^0{24}[0-9a-f]{40}$") & ~digits.rlike("^0{64}$"), F.concat(F.lit("0x"), F.right(digits, F.lit(40))))


def as_number(digits: Column) -> Column:
    """A word as DECIMAL(38,0); null where it needs more than 31 hexadecimal digits."""
    part = lambda a, n: F.conv(F.substring(digits, a, n), 16, 10).cast(NUMBER)
    shift = lambda c, n: (c * F.lit(Decimal(16**n)).cast(NUMBER)).cast(NUMBER)
    value = (shift(part(34, 1), 30) + shift(part(35, 15), 15) + part(50, 15)).cast(NUMBER)
    return F.when(digits.rlike("^0{33}"), value)


def as_small(digits: Column) -> Column:
    """A word as a long; null where it needs more than 15 hexadecimal digits."""
    return F.when(digits.rlike("^0{49}"), F.conv(F.right(digits, F.lit(15)), 16, 10).cast("long"))


def significant(digits: Column) -> Column:
    """The word's hexadecimal digits without leading zeros, as text (any of 256 bits)."""
    return F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.when(digits.isNotNull(), F.lit("0")))


#: Functions that change a Safe's owners; the slots of the previous, old and new owner, and of
#: the threshold.
SAFE_CALLS = {
    "0xe318b52b": ("swapOwner", 0, 1, 2, None),
    "0x0d582f13": ("addOwnerWithThreshold", None, None, 0, 1),
    "0xf8dc5dd9": ("removeOwner", 0, 1, None, 2),
    "0x694e80c3": ("changeThreshold", None, None, None, 0),
}


def safe_change(calldata: Column) -> Column:
    """struct(method, prev_owner, old_owner, new_owner, threshold), null for other calls."""

    def read(data: Column) -> Column:
        out = F.lit(None)
        for code, (method, *owners, threshold) in SAFE_CALLS.items():
            fields = [(F.lit(None).cast("string") if s is None else as_address(word(data, s))).alias(n) for n, s in zip(("prev_owner", "old_owner", "new_owner"), owners, strict=True)]
            number = (F.lit(None).cast("long") if threshold is None else as_small(word(data, threshold))).alias("threshold")
            out = F.when(selector(data) == code, F.struct(F.lit(method).alias("method"), *fields, number)).otherwise(out)
        return out

    return let(clean(calldata), read)


#: Selectors of deposit, submit, wrap; and of withdraw, unwrap.
WRAPS = ("0xd0e30db0", "0xa1903eab", "0xea598cb0", "0x4dcd4547")
UNWRAPS = ("0x2e1a7d4d", "0xde0e9a3e")


def wrap_event(calldata: Column, value: Column) -> Column:
    """struct(direction, amount DECIMAL) of a call to a wrapper contract: a wrap's amount is the value
    sent, or else the first word; an unwrap's is the first word.  Null without an amount."""

    def read(data: Column) -> Column:
        wrap, unwrap = selector(data).isin(*WRAPS), selector(data).isin(*UNWRAPS)
        amount = F.when(wrap & (value > 0), value.cast(NUMBER)).when(wrap | unwrap, as_number(word(data, 0)))
        return let(amount, lambda n: F.when(n > 0, F.struct(F.when(wrap, "wrap").otherwise("unwrap").alias("direction"), n.alias("amount"))))

    return let(clean(calldata), read)


#: The numbers by which a maker's bridge names its chains, and the chain of ours, if any.
MAKER_CHAINS = {1: "ethereum", 2: "arbitrum", 3: "zksync", 5: "ethereum", 6: "polygon", 7: "optimism", 10: "metis", 14: "zksync", 15: "bsc", 17: "polygon_zkevm", 19: "scroll", 21: "base", 23: "linea", 31: "manta"}
#: Chains whose amounts have a bounded number of bits.
MAKER_LIMITS = {"zksync_lite": 35, "immutablex": 28, "dydx": 28}
MARKER = 9000


def maker_destination(amount: Column, source: Column) -> Column:
    """struct(code, chain) that the amount's last four digits name (9000 and the chain's number).  On
    chains with bounded amounts the digits stand at the end of the valid ones."""
    plain = F.regexp_replace(F.regexp_replace(amount, r"^0+(\d)", "$1"), r"(\d)0+$", "$1")
    seen = amount
    for name, bits in MAKER_LIMITS.items():
        top = str(2**bits - 1)
        valid = F.when(plain.try_cast(NUMBER) > int(top), len(top) - 1).otherwise(len(top))
        cut = (F.lower(source) == name) & (F.length(plain) <= len(top)) & (F.length(amount) > valid)
        seen = F.when(F.coalesce(cut, F.lit(False)), F.substring(amount, F.lit(1), valid)).otherwise(seen)
    code = F.right(seen, F.lit(4)).cast("int") - MARKER
    chain = reduce(lambda c, pair: c.when(code == pair[0], pair[1]), list(MAKER_CHAINS.items())[1:], F.when(code == 1, "ethereum"))
    return F.when(F.trim(amount).rlike(r"^\d{4,}$") & (code > 0) & (code < 1000), F.struct(code.alias("code"), chain.alias("chain")))


#: Channels of which the other end is known, and denominations of a freezable dollar.
IBC_CHANNELS = {("osmosis", "channel-0"): "cosmoshub", ("osmosis", "channel-750"): "noble"}
FREEZABLE_DENOMS = ("uusdc",)
IBC_EVENT = "array<struct<type: string, attributes: array<struct<key: string, value: string>>>>"
IBC_PACKET = "sender string, receiver string, denom string, amount string"


def base_denom(denom: Column) -> Column:
    """Without the leading port/channel-n/ hops."""
    return F.regexp_replace(F.coalesce(denom, F.lit("")), r"^(?:[a-z0-9.\-]+/channel-\d+/)+", "")


def ibc_sends(events: Column, zone: Column) -> Column:
    """array<struct> of the token packets that a transaction's events (JSON) send: sender, receiver, denom,
    base_denom, amount (digits), src_channel, dst_channel, sequence, dest_chain, freezable.  Broken packets
    are skipped, never repaired."""
    parsed = F.filter(F.from_json(events, IBC_EVENT), lambda e: e["type"] == "send_packet")

    def one(e: Column) -> Column:
        has = F.map_from_entries(F.filter(e["attributes"], lambda a: a["key"].isNotNull() & a["value"].isNotNull()))
        packet = F.from_json(has["packet_data"], IBC_PACKET)
        channel = has["packet_src_channel"]
        known = F.lit(None).cast("string")
        for (own, name), far in IBC_CHANNELS.items():
            known = F.when((zone == own) & (channel == name), F.lit(far)).otherwise(known)
        base = base_denom(packet["denom"])
        return F.struct(
            has["packet_src_port"].alias("port"), packet["sender"].alias("sender"), packet["receiver"].alias("receiver"), packet["denom"].alias("denom"), base.alias("base_denom"), packet["amount"].alias("amount"),
            channel.alias("src_channel"), has["packet_dst_channel"].alias("dst_channel"), has["packet_sequence"].alias("sequence"), known.alias("dest_chain"), base.isin(*FREEZABLE_DENOMS).alias("freezable"),
        )

    sent = F.transform(parsed, one)
    return F.filter(sent, lambda s: (s["port"] == "transfer") & (s["sender"] != "") & (s["receiver"] != "") & (s["denom"] != "") & s["amount"].rlike(r"^0*[1-9]\d*$"))


# Logs by which value is parked in a position and leaves it.  Kind, role, topic, the words
# that name the position, the receiver and the amounts; t1 is the first topic after the event's, d0 the first word of data.
POSITION_EVENTS = [
    ("lp", "park", "0x3067048beee31b25b2f1681f88dac838c8bba36af25bfb2b7cf7473a5847e35f", ["t1"], None, ["d1", "d2"]),
    ("lp", "exit", "0x40d0efd1a53d60ecbf40971b9daf7dc90178c3aadc7aab1765632738fa8b8f01", ["t1"], "d0", ["d1", "d2"]),
    ("lending", "park", "0x2b627736bca15cd5381dcf80b0bf11fd197d01a037c52b927a881a10fb73ba61", ["t1", "t2"], None, ["d1"]),
    ("lending", "exit", "0x3115d1449a7b732c986cba18244e897a450f61e1bb8d589cd2e69e6c8924f9f7", ["t1", "t2"], "t3", ["d0"]),
    ("market", "exit", "0x9b1bfa7fa9ee420a16e124f794c35ac9f90472acc99140eb2f6447c714cad8eb", ["t1"], "t2", ["d0"]),
    ("vault", "park", "0xdcbc1c05240f31ff3ad067ef1ee35ce4997762752e3a095284754544f4c709d7", ["t2"], None, ["d0"]),
    ("vault", "exit", "0xfbde797d201c681b91056529119e0b02407c7bb96a4a2c75c01fc9667232c8db", ["t3"], "t2", ["d0"]),
]


def position_events(logs: DataFrame, managers: list[str], markets: list[str] | None = None) -> DataFrame:
    """chain, contract, block, tx, log, kind, role, position, recipient, amount0, amount1 (decimal digits) of the
    logs (chain, contract, block, tx, log, topics, data) that park value or take it out.

    Logs are kept by their topic before anything is read; each is then read by its own kind.
    Liquidity positions count only at the managers' contracts, whose numbers are theirs
    alone, and withdrawals from a market (whose event many contracts share) only at the
    markets'.  Other logs, and those without the words that name a position, are left out.
    """
    code, contract = F.lower(F.get("topics", F.lit(0))), F.lower("contract")
    by_code = {e[2]: e for e in POSITION_EVENTS}
    kept = logs.where(code.isin(list(by_code))).select("chain", contract.alias("contract"), "block", "tx", "log", code.alias("code"), *(abi.whole(abi.raw(F.get("topics", F.lit(i)))).alias(f"t{i}") for i in (1, 2, 3)), abi.raw(F.col("data")).alias("data"))
    kept = kept.select("chain", "contract", "block", "tx", "log", "code", "t1", "t2", "t3", *(abi.whole(abi.word(F.col("data"), abi.WORD * i)).alias(f"d{i}") for i in range(3)))

    def chosen(of: Callable[[tuple], Column | None]) -> Column:
        cases = [(k, of(e)) for k, e in by_code.items()]
        return reduce(lambda c, x: c.when(F.col("code") == x[0], x[1]), [x for x in cases if x[1] is not None], F.when(F.lit(False), F.lit(None)))

    kind, role = chosen(lambda e: F.lit(e[0])), chosen(lambda e: F.lit(e[1]))
    position = chosen(lambda e: F.lower(F.hex(F.concat(*(F.col(p) for p in e[3])))))
    words = [chosen(lambda e, i=i: F.col(e[5][i]) if len(e[5]) > i else None) for i in range(2)]
    read = kept.select("chain", "contract", "block", "tx", "log", kind.alias("kind"), role.alias("role"), position.alias("position"), chosen(lambda e: F.col(e[4]) if e[4] else None).alias("to"), words[0].alias("w0"), words[1].alias("w1"))
    read = read.where(F.col("position").isNotNull() & ((F.col("kind") != "lp") | F.col("contract").isin(managers)) & ((F.col("kind") != "market") | F.col("contract").isin(markets or [])))
    read = read.select("chain", "contract", "block", "tx", "log", "kind", "role", "position", abi.address_of(F.col("to")).alias("recipient"), F.col("w0").alias("amount0"), F.col("w1").alias("amount1"))
    return abi.numbered(read, "amount0", "amount1")
