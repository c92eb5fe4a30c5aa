"""Where bridge calls ask to send value: one walk over the call's bytes, driven by a table of
layouts.

A layout says in which tuple (if any) the fields stand, which slot names the chain and in
which numbering, and which slots hold or point to the recipient.  The table has a row for
each known function and is broadcast; all calls go through the same few projections.  What
a call says is what the sender asked for, not that it arrived, so the confidence is medium
with a chain or an address, else low.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import abi

# ---- fixed values: public identifiers of chains and of bridge functions

EVM_CHAINS = {1: "ethereum", 10: "optimism", 137: "polygon", 42161: "arbitrum", 8453: "base", 324: "zksync", 56: "bsc", 43114: "avalanche"}
CCTP_DOMAINS = {0: "ethereum", 1: "avalanche", 2: "optimism", 3: "arbitrum", 5: "solana", 6: "base", 7: "polygon"}
LAYERZERO_CHAINS = {101: "ethereum", 102: "bsc", 106: "avalanche", 109: "polygon", 110: "arbitrum", 111: "optimism", 112: "fantom", 184: "base", 195: "linea"}
LAYERZERO_V2 = {30101: "ethereum", 30102: "bsc", 30106: "avalanche", 30109: "polygon", 30110: "arbitrum", 30111: "optimism", 30112: "fantom", 30183: "linea", 30184: "base", 30214: "scroll", 30253: "zksync"}
WORMHOLE_CHAINS = {
    1: "solana", 2: "ethereum", 4: "bsc", 5: "polygon", 6: "avalanche", 7: "oasis", 10: "fantom", 11: "karura", 12: "acala", 13: "klaytn", 14: "celo",
    16: "moonbeam", 18: "terra2", 19: "injective", 21: "sui", 22: "aptos", 23: "arbitrum", 24: "optimism", 25: "gnosis", 30: "base",
}
CONNEXT_DOMAINS = {6648936: "ethereum", 1869640809: "optimism", 1886350457: "polygon", 1634886255: "arbitrum", 6450786: "bsc", 6778479: "gnosis", 1650553709: "base", 1818848877: "linea"}
CCIP_SELECTORS = {
    5009297550715157269: "ethereum", 4051577828743386545: "polygon", 4949039107694359620: "arbitrum", 3734403246176062136: "optimism",
    15971525489660198786: "base", 6433500567565415381: "avalanche", 11344663589394136015: "bsc",
}
NUMBERINGS = {
    "evm": EVM_CHAINS, "cctp": CCTP_DOMAINS, "layerzero": LAYERZERO_CHAINS, "layerzero2": LAYERZERO_V2, "stargate2": LAYERZERO_CHAINS | LAYERZERO_V2,
    "wormhole": WORMHOLE_CHAINS, "connext": CONNEXT_DOMAINS, "ccip": CCIP_SELECTORS,
}
#: Chains that are named by text; any other name stays as it is, in lower case.
NAMED_CHAINS = {
    "ethereum": "ethereum", "polygon": "polygon", "avalanche": "avalanche", "fantom": "fantom", "moonbeam": "moonbeam", "binance": "bsc", "bsc": "bsc", "arbitrum": "arbitrum",
    "optimism": "optimism", "base": "base", "linea": "linea", "celo": "celo", "kava": "kava", "filecoin": "filecoin", "osmosis": "cosmos", "axelar": "cosmos",
}
MEMO_CHAINS = {"BTC": "bitcoin", "ETH": "ethereum"}

#: Fields at fixed places: protocol, selector, method, words at least, numbering and slot of the chain (or its
#: name), slot of the recipient (None: the sender himself).
FLAT = [
    ("across", "0x7b939232", "depositV3", 7, ("evm", 6), 1),
    ("across", "0xf0826b7d", "deposit", 4, ("evm", 3), 0),
    ("cctp", "0x6fd3504e", "depositForBurn", 4, ("cctp", 1), 2),
    ("cctp", "0xf856ddb6", "depositForBurnWithCaller", 4, ("cctp", 1), 2),
    ("connext", "0x8aac16ba", "xcall", 7, ("connext", 0), 1),
    ("hop", "0xdeace8f5", "sendToL2", 7, ("evm", 0), 1),
    ("hop", "0xa6df7b8c", "sendToL2", 7, ("evm", 0), 1),
    ("celer", "0xa5977fbb", "send", 5, ("evm", 3), 0),
    ("celer", "0x3f2e5fc3", "sendNative", 5, ("evm", 2), 0),
    ("synapse", "0xfa9d8e22", "bridge", 2, ("evm", 1), 0),
    ("synapse", "0xf1a64348", "swapAndRedeem", 2, ("evm", 1), 0),
    ("multichain", "0xedbdf5e2", "anySwapOutUnderlying", 4, ("evm", 3), 1),
    ("multichain", "0x241dc2df", "anySwapOut", 4, ("evm", 3), 1),
    ("wormhole", "0x0f5287b0", "transferTokens", 6, ("wormhole", 2), 3),
    ("wormhole", "0xc5a5ebda", "transferTokensWithPayload", 6, ("wormhole", 2), 3),
    ("wormhole", "0x9981509f", "wrapAndTransferETH", 4, ("wormhole", 0), 1),
    ("arbitrum_l1", "0xd2ce7d65", "outboundTransfer", 0, ("is", "arbitrum"), 1),
    ("arbitrum_l1", "0x4fb1a07b", "outboundTransferCustomRefund", 0, ("is", "arbitrum"), 2),
    ("arbitrum_l1", "0x439370b1", "depositEth", 0, ("is", "arbitrum"), None),
    ("zksync_l1", "0xe8b99b1b", "deposit", 0, ("is", "zksync"), 0),
]
#: The same functions on several bridges: the chain that each leads to.
ROOT_CHAINS = {"polygon_pos": "polygon", "polygon_zkevm": "polygon_zkevm"}
ROOT_CALLS = [("0xe3dec8fb", "depositFor", 0), ("0x4faa8a26", "depositEtherFor", 0)]
STANDARD_BRIDGES = {"optimism_l1": "optimism", "base_l1": "base", "linea": "linea", "scroll": "scroll", "blast": "blast", "opbnb": "opbnb", "mantle": "mantle", "manta": "manta"}
STANDARD_CALLS = [("0x838b2520", "depositERC20To", 2), ("0x9a2ac6d5", "depositETHTo", 0), ("0x58a997f6", "depositERC20", None), ("0xb1a1a882", "depositETH", None)]
STANDARD_RETURN = ("0xa3a79548", "withdrawTo", 1)
#: Dynamic fields: protocol, selector, method, words at least, kind, slot of the tuple (None: the arguments
#: themselves), numbering and slot of the chain, slots that hold or point to the recipient.
DYNAMIC = [
    ("stargate", "0x9fbf10fc", "swap", 9, "exact20", None, ("layerzero", 0), 7),
    ("stargate", "0x1114cd2a", "swapETH", 5, "exact20", None, ("layerzero", 0), 2),
    ("stargate", "0xcbef2aa9", "sendToken_v2", 4, "word", 0, ("stargate2", 0), 1),
    ("layerzero", "0xc5803100", "send_v1", 6, "first20", None, ("layerzero", 0), 1),
    ("layerzero", "0x2637a450", "send_v2", 6, "word", 0, ("layerzero2", 0), 1),
    ("ccip", "0x96f4e9f9", "ccipSend", 4, "last20", 1, ("ccip", 0), 0),
    ("axelar", "0xb5417084", "callContractWithToken", 4, "named", None, (None, 0), 1),
    ("axelar", "0x26ef699d", "sendToken", 4, "named", None, (None, 0), 1),
    ("squid", "0x84d2bb4d", "bridgeCall", 4, "named", None, (None, 0), 1),
    ("squid", "0x32fb1360", "callBridgeCall", 4, "named", None, (None, 0), 1),
    ("thorchain", "0x44bc937b", "depositWithExpiry", 0, "memo", None, (None, 0), 3),
    ("thorchain", "0x1fece7b4", "deposit", 0, "memo", None, (None, 0), 3),
    ("debridge", "0xfb96b66e", "createSaleOrder", 8, "order", 0, ("evm", 4), 5),
    ("debridge", "0xfaee513f", "createOrder", 8, "order", 0, ("evm", 4), 5),
    ("debridge", "0xb3c10b67", "send", 8, "order", 0, ("evm", 4), 5),
    ("debridge", "0xb9303701", "createSaltedOrder", 8, "order", 0, ("evm", 4), 5),
    ("symbiosis", "0xa11b1198", "metaRoute", 10, "nested", 0, ("evm", 0), 8),
    ("lifi", "0xfbb73a4f", "swapAndStartBridgeTokensViaStargate", 10, "routed", 0, ("evm", 7), 5),
    ("lifi", "0x6cf26d72", "swapAndStartBridgeTokensViaAcross", 10, "routed", 0, ("evm", 7), 5),
    ("lifi", "0x42a2b1cd", "swapAndStartBridgeTokensViaHop", 10, "routed", 0, ("evm", 7), 5),
    ("lifi", "0xed178619", "startBridgeTokensViaStargate", 10, "routed", 0, ("evm", 7), 5),
    ("lifi", "0xb4c20477", "startBridgeTokensViaAcross", 10, "routed", 0, ("evm", 7), 5),
    ("lifi", "0x4666fc80", "swapTokensGeneric", 10, "routed", 0, ("evm", 7), 5),
]
#: Recognised, with a destination that the call doesn't say.
KNOWN = [("1inch", "0x12aa3caf", "swap"), ("1inch", "0x0502b1c5", "unoswap"), ("1inch", "0xe449022e", "uniswapV3Swap")]
#: Where the chain of an order may stand, in the order in which the slots are tried.
ORDER_SLOTS = (4, 3, 5, 6, 7, 2)
#: Where the fields of a routed call may begin, if not in the tuple that its first argument points to.
ROUTED_BASES = (abi.ARGUMENTS, abi.ARGUMENTS + 160, abi.ARGUMENTS + 256)
#: Words of a nested call that may name its chain.
NESTED_WORDS = 8
#: A protocol by its name in free text: the first entry of which all words occur and none of the others.
PROTOCOL_NAMES = [
    ("wormhole", "wormhole", ""), ("across", "across", ""), ("stargate", "stargate", ""), ("debridge", "debridge", ""), ("1inch", "1inch", ""), ("connext", "connext", ""), ("connext", "everclear", ""), ("axelar", "axelar", ""),
    ("lifi", "lifi", ""), ("lifi", "li.fi", ""), ("hop", "hop", "hopr"), ("squid", "squid", ""), ("celer", "celer", ""), ("celer", "cbridge", ""), ("synapse", "synapse", ""), ("symbiosis", "symbiosis", ""), ("thorchain", "thorchain", ""),
    ("layerzero", "layerzero", ""), ("ccip", "ccip", ""), ("cctp", "cctp", ""), ("cctp", "circle", ""), ("multichain", "multichain", ""), ("multichain", "anyswap", ""), ("polygon_zkevm", "polygon zkevm", ""), ("polygon_pos", "polygon pos", ""),
    ("polygon_pos", "polygon rootchainmanager", ""), ("polygon_pos", "polygon erc20predicate", ""), ("optimism_l1", "optimism standardbridge", ""), ("arbitrum_l1", "arbitrum inbox", ""), ("arbitrum_l1", "arbitrum gateway", ""), ("zksync_l1", "zksync bridge", ""),
    ("zksync_l1", "zksync era", ""), ("base_l1", "base standardbridge", ""), ("linea", "linea", ""), ("scroll", "scroll", ""), ("blast", "blast", ""), ("opbnb", "opbnb", ""), ("mantle", "mantle", ""), ("manta", "manta pacific", ""),
]

LAYOUT = "protocol string, code string, method string, least int, kind string, tuple int, numbering string, chain_slot int, chain_is string, slot int"


def layouts() -> list[tuple]:
    """The rows of ``LAYOUT``."""
    flat = [(p, c, m, n, "sender" if at is None else "word", None, None if kind == "is" else kind, None if kind == "is" else where, where if kind == "is" else None, at) for p, c, m, n, (kind, where), at in FLAT]
    fixed = [(p, c, m, at, chain) for p, chain in ROOT_CHAINS.items() for c, m, at in ROOT_CALLS] + [(p, c, m, at, chain) for p, chain in STANDARD_BRIDGES.items() for c, m, at in STANDARD_CALLS]
    fixed += [(p, *STANDARD_RETURN, "ethereum") for p in STANDARD_BRIDGES]
    flat += [(p, c, m, 0, "sender" if at is None else "word", None, None, None, chain, at) for p, c, m, at, chain in fixed]
    dynamic = [(p, c, m, n, kind, tuple_, numbering, chain_at, None, at) for p, c, m, n, kind, tuple_, (numbering, chain_at), at in DYNAMIC]
    return flat + dynamic + [(p, c, m, 0, "known", None, None, None, None, None) for p, c, m in KNOWN]


def protocol_key(name: Column) -> Column:
    """The layouts' name of a protocol that is named in free text ('THORChain Router'); a name that is a key stays."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"[ \-:]", "")
    keys = sorted({row[0] for row in layouts()})
    out = F.when(F.lower(F.trim(name)).isin(keys), F.lower(F.trim(name)))
    for key, words, without in PROTOCOL_NAMES:
        has = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words.split()])
        out = out.when(has & ~F.contains(low, F.lit(without)) if without else has, key)
    return out


def hex_key(number: int) -> str:
    return f"{number:064x}".upper()


def _is_evm(word: Column) -> Column:
    return F.hex(word).isin([hex_key(n) for n in EVM_CHAINS])


def _first(found: list[Column]) -> Column:
    return F.coalesce(*found)


def bridge_destinations(calls: DataFrame) -> DataFrame:
    """calls (protocol, calldata, any others) -> the others, method, chain, address, confidence and to_sender of
    each call, all null for calls that aren't known.

    Broken or short calls keep their method and lose what can't be read.  Recipients of 32
    bytes are written as the destination chain writes them (Base58 on solana) and left out
    where that isn't known.
    """
    spark = calls.sparkSession
    table = spark.createDataFrame(layouts(), LAYOUT)
    numbers = [(kind, hex_key(number), name) for kind, names in NUMBERINGS.items() for number, name in names.items()]
    chains = spark.createDataFrame(numbers, "numbering string, number string, chain_name string")
    others = [c for c in calls.columns if c not in ("protocol", "calldata")]
    kept = [*others, "data", "method", "kind", "numbering", "chain_is", "slot"]
    rows = calls.select(*others, protocol_key(F.col("protocol")).alias("protocol"), abi.raw(F.col("calldata")).alias("data"))
    rows = rows.withColumn("code", abi.selector(F.col("data"))).join(F.broadcast(table), ["protocol", "code"], "left")
    data, kind = F.col("data"), F.col("kind")
    enough = F.length(data) >= abi.ARGUMENTS + abi.WORD * F.col("least")

    # where the fields begin: a tuple's offset counts from the arguments; a wild one gives way to the usual place
    usual = abi.ARGUMENTS + F.when(F.col("method") == "sendToken_v2", 128).when(F.col("tuple") == 1, 64).otherwise(32)
    led = abi.follow(data, abi.ARGUMENTS, F.col("tuple"))
    base = F.when(F.col("tuple").isNull(), abi.ARGUMENTS).otherwise(F.when((led >= abi.ARGUMENTS + abi.WORD) & (led + 2 * abi.WORD <= F.length(data)), led).otherwise(usual))
    rows = rows.withColumn("data", F.when(enough, data)).select(*kept, "chain_slot", base.cast("long").alias("base"))

    # orders and routed calls come in variants: the first place at which a chain stands
    routed = lambda at: F.when(_is_evm(abi.slot(data, at, 7)) & abi.address(abi.slot(data, at, 5)).isNotNull(), at)
    base = F.when(kind == "routed", _first([routed(b) for b in (F.col("base"), *(F.lit(b).cast("long") for b in ROUTED_BASES))])).otherwise(F.col("base"))
    spot = F.when(kind == "order", _first([F.when(_is_evm(abi.slot(data, F.col("base"), s)), s) for s in ORDER_SLOTS])).otherwise(F.col("chain_slot"))
    rows = rows.select(*kept, base.alias("base"), spot.alias("spot")).withColumn("slot", F.when(kind == "order", F.col("spot") + 1).otherwise(F.col("slot")))

    # what stands in the recipient's slot, or what it points to
    at, pointed = F.col("base"), ["exact20", "first20", "last20", "named", "memo", "order", "nested"]
    rows = rows.select(*kept, "base", "spot", F.when(kind.isin("word", "routed"), abi.slot(data, at, F.col("slot"))).alias("word"), F.when(kind.isin(pointed), abi.follow(data, at, F.col("slot"))).alias("place"), F.when(kind == "named", abi.follow(data, at, 0)).alias("name_place"))
    rows = rows.select(*kept, "base", "spot", "word", abi.blob(data, F.col("place")).alias("body"), abi.blob(data, F.col("name_place")).alias("name"))

    # a nested call's chain: its selector is four bytes that no padded word has
    body = F.col("body")
    selected = (F.substring(body, 1, 4) != F.lit(bytes(4))) & (F.substring(body, 5, 24) == F.lit(bytes(24)))
    inner = lambda skip: [F.when(_is_evm(abi.word(body, skip + abi.WORD * i)), F.hex(abi.word(body, skip + abi.WORD * i))) for i in range(NESTED_WORDS)]
    number = F.when(kind == "nested", _first([F.when(selected, _first(inner(4))), _first(inner(0))])).when(kind == "last20", F.hex(abi.slot(data, abi.ARGUMENTS, 0))).otherwise(F.hex(abi.slot(data, at, F.col("spot"))))
    said = F.when(kind == "memo", abi.text(body)).when(kind == "named", F.trim(abi.text(body)))
    rows = rows.select(*kept, "word", "body", number.alias("number"), said.alias("said"), F.lower(F.trim(abi.text(F.col("name")))).alias("name"), F.when(kind == "nested", abi.slot(data, at, 7)).alias("relay"))

    memo = F.split(F.when(F.contains("said", F.lit(":")), F.col("said")), ":")
    code = F.upper(F.trim(F.get(F.split(F.trim(F.get(memo, F.lit(1))), r"\."), F.lit(0))))
    named = lambda names, key, other: reduce(lambda c, item: c.when(key == item[0], item[1]), names.items(), F.when(F.lit(False), "")).otherwise(other)
    text_chain = F.when(kind == "memo", named(MEMO_CHAINS, code, F.nullif(F.lower(code), F.lit("")))).when(kind == "named", named(NAMED_CHAINS, F.col("name"), F.col("name")))
    to = F.trim(F.get(memo, F.lit(2)))
    plain = F.when((F.length(to) > 8) & (F.length(to) < 100) & to.rlike(r"^[\p{L}\p{N}_\-]+$") & to.rlike(r"[\p{L}\p{N}]"), to)
    shaped = F.when((F.startswith("said", F.lit("0x")) & (F.length("said") == 42)) | ((F.length("said") > 10) & (F.length("said") < 100) & F.col("said").rlike(r"^[\p{L}\p{N}_:\-]+$") & F.col("said").rlike(r"[\p{L}\p{N}]")), F.col("said"))
    rows = rows.join(F.broadcast(chains), ["numbering", "number"], "left").withColumn("chain", F.coalesce("chain_is", "chain_name", text_chain))

    size, filled = F.length(body), lambda b: F.when(b != F.lit(bytes(20)), abi.as_address(b))
    solana = (F.col("chain") == "solana") & (F.substring("word", 1, 12) != F.lit(bytes(12)))
    address = (
        F.when(kind.isin("word", "routed"), F.when(solana, abi.base58(F.col("word"))).when(F.coalesce((F.col("numbering") != "wormhole") | (F.col("chain") != "solana"), F.col("numbering").isNull()), abi.address(F.col("word"))))
        .when(kind == "exact20", F.when(size == 20, filled(body)))
        .when(kind == "first20", F.when(size.between(20, 128), filled(F.substring(body, 1, 20))))
        .when(kind == "last20", F.when(size.between(20, 128), filled(F.substring(body, -20, 20))))
        .when(kind == "order", F.when(size.between(20, 128), filled(F.substring(body, -20, 20))).when(size.between(1, 19), abi.as_address(body)))
        .when(kind == "nested", abi.address(F.col("relay")))
        .when(kind == "memo", plain)
        .when(kind == "named", shaped)
    )
    rows = rows.withColumn("address", address)
    usable = F.when(kind == "memo", F.col("chain").isNotNull() & F.col("address").isNotNull()).otherwise(F.col("chain").isNotNull() | F.col("address").isNotNull() | ((F.col("numbering") == "wormhole") & data.isNotNull()))
    confidence = F.when(F.col("method").isNotNull(), F.when(usable, "medium").otherwise("low"))
    return rows.select(*others, "method", "chain", "address", confidence.alias("confidence"), F.when(F.col("method").isNotNull(), kind == "sender").alias("to_sender"))
