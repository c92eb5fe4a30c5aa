"""Decoders against encodings that are written here, byte by byte, and published vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgertide.functions import abi
from ledgertide.functions import calldata as C
from ledgertide.functions import checksums as K
from ledgertide.functions import expressions as X
from ledgertide.operators.bridge_calls import bridge_destinations, protocol_key
from ledgertide.operators.bundles import inner_transfers, user_operations
from ledgertide.operators.joins import withdrawals_elsewhere
from ledgertide.plans.decoder_queries import ON_CHAIN_ORDER, ON_CHAIN_SWAP
from ledgertide.plans.scalar_queries import SEGWIT_VECTORS


def word(n):
    return f"{n:064x}"


def encode(items):
    """Plain encoder: ints are words, bytes and str dynamic, tuples dynamic tuples, lists arrays."""
    head, tail, at = "", "", 32 * len(items)
    for x in items:
        if isinstance(x, int):
            head += word(x)
            continue
        if isinstance(x, str):
            x = x.encode()
        if isinstance(x, bytes):
            body = word(len(x)) + x.hex() + "00" * (-len(x) % 32)
        elif isinstance(x, list):
            body = word(len(x)) + encode(x)
        else:
            body = encode(list(x))
        head += word(at)
        tail += body
        at += len(body) // 2
    return head + tail


def call(code, *items):
    return code + encode(items)


A, B, D = (int("11" * 19 + f"{k:02x}", 16) for k in (1, 2, 3))
hexed = lambda n: f"0x{n:040x}"


def test_words_and_numbers(spark):
    r = random.Random(3)
    values = [0, 1, 10**8, 2**128, 2**256 - 1] + [r.randrange(2 ** r.randrange(1, 257)) for _ in range(40)]
    rows = spark.createDataFrame([(word(v), str(v)) for v in values], "h string, t string").withColumn("w", abi.raw(F.col("h")))
    found = rows.select("t", abi.number(F.col("w")).alias("n"), abi.digits(abi.limbs_of_digits(F.col("t"))).alias("back"), abi.base58(F.col("w")).alias("b"), F.hex("w").alias("raw")).collect()
    assert all(x.t == x.n == x.back and K.base58_bytes(x.b).hex() == x.raw.lower() for x in found)
    total = rows.agg(*abi.limb_sums(abi.limbs(F.col("w")))).select(abi.summed().alias("s")).first().s
    assert int(total) == sum(values)
    scaled = spark.createDataFrame([("1", 18, "0.000000000000000001"), ("1500", 3, "1.5"), ("0", 4, "0"), ("12", 0, "12"), (str(2**256 - 1), 18, "115792089237316195423570985008687907853269984665640564039457.584007913129639935"), (None, 3, None)], "d string, p int, want string")
    assert all(x.got == x.want for x in scaled.select("want", abi.scaled(F.col("d"), F.col("p")).alias("got")).collect())


def test_readers_refuse_what_is_not_there(spark):
    rows = spark.createDataFrame([("0xzz",), (None,), ("0x1234",), ("0x" + "ff" * 40,), ("0x12345678" + word(2**200 + 2**31),)], "h string").select(abi.raw(F.col("h")).alias("d"))
    read = rows.select(abi.small(abi.word(F.col("d"), 4)).alias("s"), abi.address(abi.word(F.col("d"), 4)).alias("a"), abi.number(abi.word(F.col("d"), 20)).alias("n"), abi.follow(F.col("d"), 4, 0).alias("f")).collect()
    assert all(x == (None, None, None, None) for x in map(tuple, read))


CALLS = [
    # protocol, calldata, method, chain, address, confidence
    ("THORChain Router", ON_CHAIN_SWAP, "depositWithExpiry", "bitcoin", "bc1q8w2ypqgx39gucxcypqv2m90wz9rvhmmrcnpdjs", "medium"),
    ("deBridge DLN Source", ON_CHAIN_ORDER, "createSaltedOrder", "ethereum", "0xc1ee32fac1d9a0ce63021467e34164df3078289b", "medium"),
    ("thorchain", call("0x44bc937b", A, 0, 10**18, "=:DOGE.DOGE:DQA5xxxxxxxxxxxxxxxxxxxxxxx:0/1/0", 9), "depositWithExpiry", "doge", "DQA5xxxxxxxxxxxxxxxxxxxxxxx", "medium"),
    ("thorchain", call("0x1fece7b4", A, 0, 1, "no grammar"), "deposit", None, None, "low"),
    ("thorchain", call("0x1fece7b4", A, 0, 1, "=:ETH.ETH:short"), "deposit", "ethereum", None, "low"),
    ("thorchain", "0x44bc937b" + word(1), "depositWithExpiry", None, None, "low"),
    ("LI.FI Diamond", call("0xed178619", (7, "stargate", "app", 0, B, A, 10**6, 42161, 0, 0), (1, 2)), "startBridgeTokensViaStargate", "arbitrum", hexed(A), "medium"),
    ("lifi", "0xb4c20477" + "".join(map(word, (7, 0, 0, 0, B, A, 5, 10, 0, 0))), "startBridgeTokensViaAcross", "optimism", hexed(A), "medium"),
    ("lifi", "0xb4c20477" + "".join(map(word, (7, 0, 0, 0, B, A, 5, 999999, 0, 0))), "startBridgeTokensViaAcross", None, None, "low"),
    ("layerzero", call("0xc5803100", 110, bytes.fromhex(hexed(A)[2:] + hexed(B)[2:]), b"payload", B, 0, b""), "send_v1", "arbitrum", hexed(A), "medium"),
    ("layerzero", call("0x2637a450", (30184, A, b"m", b"o", 0), B), "send_v2", "base", hexed(A), "medium"),
    ("layerzero", call("0x2637a450", (30184, 2**255 + 5, b"m", b"o", 0), B), "send_v2", "base", None, "medium"),
    ("Stargate", call("0xcbef2aa9", (30110, A, 1, 1, b"", b"", b""), 1, 0, B), "sendToken_v2", "arbitrum", hexed(A), "medium"),
    ("Stargate", call("0x9fbf10fc", 110, 1, 1, B, 5, 5, (0, 0, b""), bytes.fromhex(hexed(A)[2:]), b""), "swap", "arbitrum", hexed(A), "medium"),
    ("Stargate", call("0x9fbf10fc", 110, 1, 1, B, 5, 5, (0, 0, b""), b"\x01" * 32, b""), "swap", "arbitrum", None, "medium"),
    ("ccip", call("0x96f4e9f9", 4949039107694359620, (A.to_bytes(32, "big"), b"", [], 0, b"")), "ccipSend", "arbitrum", hexed(A), "medium"),
    ("Axelar Gateway", call("0x26ef699d", "Osmosis", "osmo1qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", "aUSDC", 5), "sendToken", "cosmos", "osmo1qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", "medium"),
    ("squid", call("0x84d2bb4d", "Nowhere", "some free text, no address", "x", 5), "bridgeCall", "nowhere", None, "medium"),
    ("symbiosis", call("0xa11b1198", (b"", b"", [B], B, B, 5, 0, A, bytes.fromhex("ce654c17" + word(5) + word(137) + word(0)))), "metaRoute", "polygon", hexed(A), "medium"),
    ("symbiosis", call("0xa11b1198", (b"", b"", [B], B, B, 5, 0, A, bytes.fromhex(word(5) + word(56)))), "metaRoute", "bsc", hexed(A), "medium"),
    ("debridge", call("0xfb96b66e", (B, 5, b"\x06" * 20, 6, 137, bytes.fromhex(hexed(A)[2:]), B, b"", b"", b"", b""), b"", 0, b""), "createSaleOrder", "polygon", hexed(A), "medium"),
    ("Wormhole Token Bridge", call("0x0f5287b0", B, 5, 1, int("06ddf6e1d765a193d9cbe146ceeb79ac1cb485ed5f5b37913a8cf5857eff00a9", 16), 0, 0), "transferTokens", "solana", "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA", "medium"),
    ("wormhole", call("0x0f5287b0", B, 5, 1, A, 0, 0), "transferTokens", "solana", None, "medium"),
    ("wormhole", call("0x0f5287b0", B, 5, 777, A, 0, 0), "transferTokens", None, None, "medium"),
    ("Circle CCTP", call("0x6fd3504e", 5, 6, A, B), "depositForBurn", "base", hexed(A), "medium"),
    ("Linea L1 Bridge", call("0x838b2520", B, B, A), "depositERC20To", "linea", hexed(A), "medium"),
    ("1inch", "0x12aa3caf" + word(5), "swap", None, None, "low"),
    ("across", "0xdeadbeef" + word(5), None, None, None, None),
    ("nobody", call("0x6fd3504e", 5, 6, A, B), None, None, None, None),
    ("across", "not hexadecimal", None, None, None, None),
    ("across", None, None, None, None, None),
]


def test_bridge_calls(spark):
    rows = spark.createDataFrame([(k, p, d) for k, (p, d, *_) in enumerate(CALLS)], "k int, protocol string, calldata string")
    found = {r.k: (r.method, r.chain, r.address, r.confidence) for r in bridge_destinations(rows).collect()}
    assert {k: found[k] for k in found} == {k: tuple(want) for k, (_, _, *want) in enumerate(CALLS)}


def test_protocol_names(spark):
    names = {"THORChain Router": "thorchain", "HOPR Net": None, "Hop Protocol": "hop", "Polygon zkEVM Bridge": "polygon_zkevm", "Polygon PoS: RootChainManager": "polygon_pos", "Base: L1 Standard Bridge": "base_l1", "Mayan": None, "optimism_l1": "optimism_l1"}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.k for r in rows.select("n", protocol_key(F.col("n")).alias("k")).collect()} == names


ENTRY = "0x5FF137D4b0FDCD49DcA30c7CF57E578a026d2789"
MOST = 2**256 - 1


def operation(body, sender=A):
    return (sender, 0, b"", body, 1, 1, 1, 1, 1, b"", b"")


def inner(code, *items):
    return bytes.fromhex(call(code, *items))


def test_bundles(spark):
    pay = lambda to, n: inner("a9059cbb", to, n)
    bodies = [
        inner("b61d27f6", D, 0, pay(B, 5)),
        inner("51945447", D, 0, pay(B, 6), 1),
        inner("b61d27f6", B, MOST, b""),
        pay(B, MOST),
        inner("18dfb3c7", [D, D], [pay(B, 7), inner("23b872dd", B, A, 8)]),
        inner("47e1da2a", [D, B, B], [0, 9, 0], [pay(B, 10), b"", b""]),
        inner("18dfb3c7", [D, D], [pay(B, 7)]),
        b"",
        inner("deadbeef", 1),
    ]
    bundle = "0x" + call("1fad948c", [operation(b) for b in bodies], B)
    many = "0x" + call("1fad948c", [operation(pay(B, k + 1)) for k in range(1100)], B)
    cut = "0x" + call("1fad948c", [operation(bodies[0]), operation(pay(B, 1))], B)[:-640]
    claimed = bundle[:10] + word(64) + word(B) + word(10**6) + bundle[10 + 192 :]
    rows = spark.createDataFrame([(1, ENTRY, bundle), (2, ENTRY, many), (3, ENTRY.lower(), cut), (4, ENTRY, claimed), (5, "0x" + "12" * 20, bundle), (6, ENTRY, None), (7, ENTRY, "0x1fad948c")], "tx int, to string, calldata string")
    found = user_operations(rows)
    counts = {(r.tx, r.problem): r.n for r in found.groupBy("tx", "problem").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {(1, None): 9, (2, None): 1100, (3, None): 1, (3, "operation"): 1, (4, "count"): 1, (7, "count"): 1}
    moved = inner_transfers(found.where("problem IS NULL").select("tx", "index", "sender", "call"))
    a, b, d = map(hexed, (A, B, D))
    assert sorted(tuple(r)[1:] for r in moved.where("tx = 1").collect()) == [
        (0, 0, a, b, d, "5"), (1, 0, a, b, d, "6"), (2, 0, a, b, "", str(MOST)), (3, 0, a, b, "", str(MOST)), (4, 0, a, b, d, "7"), (4, 1, b, a, d, "8"), (5, 0, a, b, d, "10"), (5, 1, a, b, "", "9"), (6, 0, a, b, d, "7"),
    ]
    assert moved.where("tx = 2").count() == 1100


def test_withdrawals_elsewhere(spark):
    codes = {(e[0], e[1]): e[2] for e in C.POSITION_EVENTS}
    topic = lambda n: "0x" + word(n)
    market = "0x" + "cc" * 20
    logs = [
        ("0xpool", 1, [codes["lending", "exit"], topic(9), topic(A), topic(B)], "0x" + word(MOST)),
        ("0xpool", 2, [codes["lending", "exit"], topic(9), topic(A), topic(A)], "0x" + word(5)),
        ("0xpool", 3, [codes["lending", "exit"], topic(9), topic(D), topic(B)], "0x" + word(5)),
        (market.upper().replace("X", "x"), 4, [codes["market", "exit"], topic(A), topic(B)], "0x" + word(7)),
        ("0xother", 5, [codes["market", "exit"], topic(A), topic(B)], "0x" + word(7)),
        ("0xpool", 6, [codes["lending", "exit"], topic(9), topic(A)], "0x" + word(7)),
        ("0xpool", 7, ["0x00"], None),
        ("0xpool", 8, None, None),
    ]
    rows = spark.createDataFrame([("ethereum", c, 1, tx, 0, t, d) for c, tx, t, d in logs], "chain string, contract string, block int, tx int, log int, topics array<string>, data string")
    wallets = spark.createDataFrame([("ethereum", hexed(A)), ("ethereum", hexed(A))], "chain string, wallet string")
    found = withdrawals_elsewhere(C.position_events(rows, [], [market]), wallets)
    assert sorted((r.tx, r.kind, r.recipient, r.amount) for r in found.collect()) == [(1, "lending", hexed(B), str(MOST)), (4, "market", hexed(B), "7")]


@pytest.mark.parametrize("address,kind", SEGWIT_VECTORS)
def test_segwit_vectors(address, kind):
    assert K.bitcoin_kind(address) == kind
    found = K.segwit_program(address)
    if found:
        assert K.segwit_address(*found) == address.lower()


def test_base58_round_trip():
    for address in ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "TNUC9Qb1rRpS5CbWLmNMxXBjyFoydXjWFR"):
        assert K.base58_text(K.base58_payload(address), checked=True) == address
    assert K.base58_text(bytes(32)) == "1" * 32


def test_exhibit_letters(spark):
    def letters(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    places = [0, 25, 26, 701, 702, 703, 18277, 18278, 475253, 475254, 10**9]
    rows = spark.createDataFrame([(p,) for p in places], "p long")
    assert {r.p: r.x for r in rows.select("p", X.exhibit_letter(F.col("p")).alias("x")).collect()} == {p: letters(p) for p in places}
