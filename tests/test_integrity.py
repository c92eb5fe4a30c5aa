"""Checks of documents: each rule with what breaks it and what doesn't."""

from __future__ import annotations

from ledgertide.operators import integrity as I

A, B, C = ("0x" + x * 20 for x in ("aa", "bb", "cc"))


def told(df):
    return sorted((r.case_id, r.check_id, r.subject) for r in df.collect())


def test_calibration(spark):
    leads = spark.createDataFrame([(1, A, "HIGH", ["Label", " label ", ""]), (1, B, "high", ["label", "transfer"]), (1, C, "low", []), (2, A, "high", None), (3, A, "medium", None)], "case_id int, address string, confidence string, sources array<string>")
    rates = spark.createDataFrame([(1, 0.04), (2, 0.2), (3, 0.01)], "case_id int, wilson_lower double")
    assert told(I.calibration(leads, rates)) == [(1, "H", A), (1, "H", "recovery rate"), (2, "H", A)]


def test_cross_document(spark):
    documents = spark.createDataFrame(
        [(1, "brief", "C-1", "Ann  Lee", 1000.0, "2024-01-02"), (1, "letter", "c-1 ", "ann lee", 1100.0, "2024-01-02"), (2, "brief", "C-2", "Bo", 500.0, "2024-01-02"), (2, "letter", "C-3", "Bob", 700.5, "2024-01-03"), (2, "handoff", None, "", None, None), (3, "brief", "x", "y", 1.0, "z")],
        "case_id int, doc_kind string, stated_case string, victim string, total_usd double, incident_date string",
    )
    addresses = spark.createDataFrame([(2, "brief", A), (2, "letter", A.upper().replace("X", "x")), (2, "brief", B), (1, "brief", A)], "case_id int, doc_kind string, address string")
    assert told(I.cross_document(documents, addresses)) == sorted([(2, "I", "case_id stated"), (2, "I", "victim_name"), (2, "I", "incident_date"), (2, "I", "total_usd"), (2, "I", A)])


def test_freeze_asks(spark):
    kind = "case_id int, issuer string, token string, address string, usd double"
    listed = spark.createDataFrame([(1, "Circle", "usdc", A, 100.0), (1, "Tether", "USDT", B, 50.0)], kind)
    asks = spark.createDataFrame([(1, "circle ", "USDC", A, 109.0), (1, "Tether", "USDT", B, 70.0), (1, "Tether", "USDT", C, None), (2, "Circle", "USDC", A, 1.0), (1, "", "USDC", A, 1.0), (1, "Circle", "USDC", A, None)], kind)
    assert told(I.freeze_asks(listed, asks)) == sorted([(1, "K", f"tether USDT {B}"), (1, "K", f"tether USDT {C}"), (2, "K", f"circle USDC {A}")])


def test_explorer_links(spark):
    links = spark.createDataFrame(
        [(1, "a.html", f"https://etherscan.io/address/{A}"), (1, "a.html", f"https://www.arbiscan.io/address/{B}"), (1, "b.html", f"https://etherscan.io/address/{B}"), (1, "b.html", f"https://tronscan.org/#/address/{C}"), (1, "c.html", "https://etherscan.io/tx/none"), (2, "d.html", f"https://polygonscan.com/address/{A.upper().replace('X', 'x')}")],
        "case_id int, file string, url string",
    )
    chains = spark.createDataFrame([(1, A, "ethereum"), (1, B, "arbitrum"), (2, A, "nowhere")], "case_id int, address string, chain string")
    assert told(I.explorer_links(links, chains)) == sorted([(1, "L", B), (1, "L", C)])


def test_grounding(spark):
    prose = spark.createDataFrame([(1, f"Sent $1.5m and $2,000.49 to {A} on Ethereum; {B} got $77 by solana, $ 3k more."), (2, None), (3, f"{A}ff is no address, $0 is none")], "case_id int, text string")
    addresses = spark.createDataFrame([(1, A.upper().replace("X", "x"))], "case_id int, address string")
    amounts = spark.createDataFrame([(1, 1_493_000.0), (1, 2_050.0), (3, 1.0)], "case_id int, usd double")
    chains = spark.createDataFrame([(1, "Ethereum")], "case_id int, chain string")
    assert told(I.grounding(prose, addresses, amounts, chains)) == sorted([(1, "O", B), (1, "O", "3000.00"), (1, "O", "77.00"), (1, "O", "solana")])
