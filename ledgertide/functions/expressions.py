"""Column expressions of the fund-flow domain.  All are built-in functions.  Those with lambdas
(``transform``, ``filter``, ``aggregate``, ``exists``) are interpreted, the others stay inside
whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EVM_ADDRESS = r"^0x[0-9a-fA-F]{40}$"
CONFIDENCE_LADDER = ("high", "medium", "low")


def canonical_key(address: Column) -> Column:
    """Join key of an address: trimmed; EVM addresses in lower case; null as ''."""
    trimmed = F.trim(address)
    return F.when(trimmed.rlike(EVM_ADDRESS), F.lower(trimmed)).otherwise(F.coalesce(trimmed, F.lit("")))


def chain_by_shape(address: Column) -> Column:
    """The family of chains whose address format fits (shape only, no checksum)."""
    a = F.trim(address)
    return (
        F.when(a.rlike(EVM_ADDRESS), "evm")
        .when(a.rlike(r"^0x[0-9a-fA-F]{64}$"), "move")
        .when(a.rlike(r"^(bc1[02-9ac-hj-np-z]{11,87}|BC1[02-9AC-HJ-NP-Z]{11,87}|[13][1-9A-HJ-NP-Za-km-z]{25,34})$"), "bitcoin")
        .when(a.rlike(r"^T[1-9A-HJ-NP-Za-km-z]{33}$"), "tron")
        .when(a.rlike(r"^(cosmos|osmo|juno|stars|axelar|noble)1[02-9ac-hj-np-z]{38,58}$"), "cosmos")
        .when(a.rlike(r"^G[A-Z2-7]{55}$"), "stellar")
        .when(a.rlike(r"^[EUk0][Qf][A-Za-z0-9_-]{46}$"), "ton")
        .when(a.rlike(r"^[1-9A-HJ-NP-Za-km-z]{32,44}$"), "solana")
        .otherwise("unknown")
    )


def is_placeholder(address: Column) -> Column:
    """Synthetic addresses carry a colon."""
    return F.contains(address, F.lit(":"))


def is_confusable(symbol: Column) -> Column:
    """A token symbol with any character beyond ASCII."""
    return symbol.rlike(r"[^\x00-\x7F]")


def shape_similarity(a: Column, b: Column) -> Column:
    """How alike two EVM addresses look in a wallet, which shows their ends: after 0x, 0.48 for equal
    first four digits, 0.48 for equal last four, 0.04 by matches of the digits 8 to 14.  1 for the same
    address, whatever its case; 0 for what isn't one or is shorter than eight digits."""
    x, y = (F.regexp_replace(F.lower(F.trim(c)), "^0x", "") for c in (a, b))
    hits = sum((F.substring(x, k, 1) == F.substring(y, k, 1)).cast("int") for k in range(8, 15))
    score = (
        F.when(F.left(x, F.lit(4)) == F.left(y, F.lit(4)), 0.48).otherwise(0.0)
        + F.when(F.right(x, F.lit(4)) == F.right(y, F.lit(4)), 0.48).otherwise(0.0)
        + F.when((F.length(x) >= 14) & (F.length(y) >= 14), hits * F.lit(0.04) / 7).otherwise(0.0)
    )
    fit = x.rlike("^[0-9a-f]+$") & y.rlike("^[0-9a-f]+$")
    return F.when(F.coalesce(fit, F.lit(False)) & (x == y), 1.0).when(F.coalesce(fit & (F.length(x) >= 8) & (F.length(y) >= 8), F.lit(False)), F.round(score, 6)).otherwise(0.0)


def significant_digits(amount: Column) -> Column:
    """Digits of a decimal string without leading and trailing zeros and the point."""
    plain = F.regexp_replace(amount, r"^-", "")
    point = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(F.regexp_replace(plain, r"0+$", ""))
    return F.length(F.regexp_replace(F.regexp_replace(point, r"\.", ""), r"^0+", "")).cast("long")


#: Whole amounts that people choose.
ROUND_AMOUNTS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000)


def looks_round(amount: Column, values: tuple[int, ...]) -> Column:
    return (amount == F.floor(amount)) & amount.cast("long").isin(*values)


def cluster_name(members: Column) -> Column:
    """Stable id of a set of addresses."""
    return F.concat(F.lit("cluster_"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\n").cast("binary"), 256), 1, 8))


def decayed_confidence(tier: Column, anchor: Column, now: Column, step_days: int = 180) -> Column:
    """The tier one step lower for each step of age, at least the lowest; unknown tiers and ages
    below zero stay."""
    ladder = F.array(*(F.lit(x) for x in CONFIDENCE_LADDER))
    place = F.array_position(ladder, tier)
    age = F.datediff(now, anchor)
    lowered = F.element_at(ladder, F.least(place + F.floor(age / step_days), F.lit(len(CONFIDENCE_LADDER))).cast("int"))
    return F.when((place > 0) & (age >= 0), lowered).otherwise(tier)


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) without trials."""
    p = successes / n
    centre = p + F.lit(z * z) / (2 * n)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    scale = 1 + F.lit(z * z) / n
    low = F.when(n > 0, F.greatest((centre - spread) / scale, F.lit(0.0))).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least((centre + spread) / scale, F.lit(1.0))).otherwise(F.lit(1.0))
    return low, high


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def parse_usd(text: Column) -> Column:
    """"$1,234.50" as a decimal; anything else as 0."""
    return F.coalesce(F.expr("null").cast("decimal(20,2)") if text is None else F.regexp_replace(F.trim(text), r"[$,]", "").try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))


def format_usd(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def scaled_amount(raw: Column, decimals: Column) -> Column:
    """A digit string as a decimal with so many places, by string (raw amounts may have 78 digits)."""
    padded = F.lpad(raw, F.greatest(F.length(raw), decimals + 1), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    return F.concat_ws(".", whole, F.when(decimals > 0, F.right(padded, decimals)))


def csv_guard(cell: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a leading apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def scrub(text: Column) -> Column:
    """Without control, bidirectional and zero-width characters."""
    return F.regexp_replace(text, "[\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F\\u007F-\\u009F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u2069\\uFEFF]", "")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def move_address(address: Column) -> Column:
    """0x and 64 hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.regexp_replace(address, "^0[xX]", "")), 64, "0"))


#: Block explorers' address pages by chain.
EXPLORERS = {
    "ethereum": "https://etherscan.io/address/",
    "polygon": "https://polygonscan.com/address/",
    "arbitrum": "https://arbiscan.io/address/",
    "base": "https://basescan.org/address/",
    "bsc": "https://bscscan.com/address/",
    "solana": "https://solscan.io/account/",
    "tron": "https://tronscan.org/#/address/",
    "bitcoin": "https://mempool.space/address/",
}


def explorer_url(chain: Column, address: Column) -> Column:
    url = F.lit(None).cast("string")
    for name, base in EXPLORERS.items():
        url = F.when(chain == name, F.concat(F.lit(base), address)).otherwise(url)
    return url


def conserves_value(source: Column, target: Column, fee: Column) -> Column:
    """target within source less the fee and source; unknown or senseless values pass."""
    known = (source > 0) & (target > 0) & (fee >= 0) & (fee < 1)
    return F.when(F.coalesce(known, F.lit(False)), (target <= source) & (target >= source * (1 - fee))).otherwise(F.lit(True))


# Phrases of answers to letters.
RETURNED_NOT = (
    "no funds", "not returned", "not been returned", "have not returned", "haven't returned", "have not yet returned", "not yet returned", "yet to return", "did not return",
    "were not returned", "unable to return", "cannot return", "won't return", "will not return", "have not", "nothing returned", "no recovery", "not recovered", "unable to recover",
)
RETURNED = ("returned to the victim", "returned to victim", "funds returned", "have returned", "remitted to", "refunded to the victim", "refunded the victim", "sent back to the victim")
PARTIAL = ("partially frozen", "partial freeze", "partially froze", "froze part", "some of the funds", "a portion of")
FROZEN = (
    "have frozen", "has been frozen", "been frozen", "funds frozen", "account frozen", "is frozen", "are frozen", "placed a hold", "placed on hold", "full freeze",
    "frozen the", "frozen all", "frozen $", "successfully frozen", "assets have been frozen", "we froze",
)
FROZEN_NOT = ("not frozen", "cannot freeze", "unable to freeze", "could not freeze", "will not freeze", "won't freeze", "not be able to freeze", "decline to freeze", "refuse to freeze")
DECLINED = (
    "unable to assist", "cannot assist", "we decline", "declined", "will not be able", "no action will be taken", "outside our jurisdiction", "not able to freeze", "cannot freeze",
    "closed without action", "require a court order", "requires a court order", "valid legal process", "will not freeze", "won't freeze", "refuse to freeze", "decline to freeze",
)
ACKNOWLEDGED = (
    "received your request", "acknowledge receipt", "we acknowledge", "under review", "investigating", "will investigate", "looking into", "reference number", "case number", "ticket",
    "our compliance team will",
)
FROZEN_ANCHORS = ("frozen", "froze", "hold", "held")
RETURNED_ANCHORS = ("returned", "remitted", "refunded", "sent back")
DOLLARS = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)"


def _says(low: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in phrases))


def _amount_after(text: Column, anchors: tuple[str, ...]) -> Column:
    """The first dollar amount at or after the earliest anchor; without an anchor the only amount."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, a), F.lit(0)) for a in anchors]
    first = F.array_min(F.array(*places))
    every = F.regexp_extract_all(text, F.lit(DOLLARS), F.lit(1))
    after = F.regexp_extract_all(F.substring(text, first, F.length(text)), F.lit(DOLLARS), F.lit(1))
    chosen = F.when(first.isNotNull(), F.get(after, F.lit(0))).when(F.size(every) == 1, F.get(every, F.lit(0)))
    return F.regexp_replace(chosen, ",", "").try_cast("decimal(20,2)")


def reply_class(text: Column) -> Column:
    """struct(outcome, confidence, frozen_usd, returned_usd, review) that an answer to a letter says.  Strong
    outcomes need an explicit phrase that isn't negated; anything else is acknowledged, with low
    confidence unless it says so."""
    raw = F.coalesce(text, F.lit(""))
    low = F.lower(raw)
    returned = ~_says(low, RETURNED_NOT) & (_says(low, RETURNED) | (F.contains(low, F.lit("returned")) & F.contains(low, F.lit("victim"))))
    placed, refused = _says(low, FROZEN), _says(low, FROZEN_NOT)
    outcome = F.when(returned, "returned_to_victim").when(_says(low, PARTIAL) | (placed & refused), "partial_freeze").when(placed, "full_freeze").when(_says(low, DECLINED), "declined").otherwise("acknowledged")
    strong = outcome != "acknowledged"
    return F.struct(
        outcome.alias("outcome"),
        F.when(strong | _says(low, ACKNOWLEDGED), "high").otherwise("low").alias("confidence"),
        F.when(outcome.isin("partial_freeze", "full_freeze"), _amount_after(raw, FROZEN_ANCHORS)).alias("frozen_usd"),
        F.when(outcome == "returned_to_victim", _amount_after(raw, RETURNED_ANCHORS)).alias("returned_usd"),
        strong.alias("review"),
    )


def canonical_json(fields: Column) -> Column:
    """A map of names to JSON values (text) as an object with sorted keys and no white space, its
    non-ASCII characters escaped."""
    keys = F.array_sort(F.map_keys(fields))
    members = F.transform(keys, lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), fields[k]))
    joined = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    units = F.transform(F.split(joined, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\u"), F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})(?=.)", "$1\\\\u")))))
    return F.array_join(units, "")


def amount_is_zero(raw: Column) -> Column:
    """Exactly zero, as digits, decimal or 0x hexadecimal; blank or unreadable amounts aren't."""
    s = F.lower(F.trim(raw))
    return F.coalesce(s.rlike(r"^0x0+$") | s.rlike(r"^[+-]?(0+(\.0*)?|\.0+)(e[+-]?\d+)?$"), F.lit(False))


def finite(value: Column) -> Column:
    """The value, or null for NaN and infinities."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def fixture_reason(victim: Column) -> Column:
    """Why a case is a test fixture, by its victim's name; '' for a real one."""
    name = F.trim(victim)
    return F.when(name.isNull(), "no victim record").when(name == "", "empty name").when(F.lower(name).rlike(r"\b(test|validation|demo|fixture|sample)\b"), "test name").otherwise("")


def safe_url(url: Column) -> Column:
    """The url if it is relative or of a harmless scheme, else '#'."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when((scheme == "") | scheme.isin("http", "https", "mailto"), u).otherwise("#")


def confirmation(sources: Column, trusted: tuple[str, ...], impact: Column, strict: Column) -> Column:
    """struct(confidence, accepted) of a label that distinct sources propose.  Where it has little impact one
    source will do; else it takes sources of two tiers, or two with a trusted one; strict chains
    always take a trusted one."""
    n = F.size(sources)
    high = F.exists(sources, lambda x: x.isin(*trusted))
    both = high & F.exists(sources, lambda x: ~x.isin(*trusted))
    enough = both | (high & (n >= 2))
    confidence = F.when(~impact, F.when(n >= 2, "medium").otherwise("low")).when(strict & ~high, "low").when(enough, "high").when(high, "medium").otherwise("low")
    return F.struct(confidence.alias("confidence"), (~impact | (enough & ~(strict & ~high))).alias("accepted"))


def freshness(updated: Column, sla: Column, now: Column) -> Column:
    """struct(age_days, status) against a number of days (30 where it says none)."""
    age = F.greatest(F.datediff(now, updated), F.lit(0)).cast("long")
    days = F.coalesce(F.nullif(sla, F.lit(0)), F.lit(30))
    return F.struct(F.when(updated.isNotNull(), age).alias("age_days"), F.when(updated.isNull(), "unknown").when(age > 2 * days, "critical").when(age > days, "stale").otherwise("fresh").alias("status"))


def exhibit_letter(place: Column) -> Column:
    """0, 1, ... as A, B, ... Z, AA, ... ZZ, AAA and so on (up to nine letters)."""
    letters = []
    for k in range(9):
        before = sum(26**i for i in range(1, k + 1))  # places with fewer letters
        letter = F.char((F.floor((place - before) / 26**k) % 26 + 65).cast("int"))
        letters.append(F.when(place >= before, letter).otherwise(F.lit("")) if k else letter)
    return F.concat(*reversed(letters))


def is_burn(address: Column) -> Column:
    """The zero address, and those that end in dead after zeros."""
    return F.coalesce(F.lower(F.trim(address)).rlike(r"^0x0{36,}(0{4}|dead|0001)$"), F.lit(False))


def traverses(depth: Column, max_depth: int, address: Column, category: Column, is_contract: Column) -> Column:
    """Whether a trace follows a transfer to its receiver: within the depth, not into a burn or a
    placeholder, not into a service that mixes many users' funds, not into a contract."""
    service = F.coalesce(category.isin("exchange", "exchange_deposit", "exchange_hot_wallet", "mixer", "bridge"), F.lit(False))
    return (depth + 1 < max_depth) & ~is_burn(address) & ~is_placeholder(address) & ~service & ~F.coalesce(is_contract, F.lit(False))


#: Chains by the names that texts give them.
CHAIN_NAMES = ("arbitrum", "avalanche", "base", "bitcoin", "bsc", "ethereum", "optimism", "polygon", "solana", "tron")


def entities(text: Column) -> Column:
    """struct(addresses, tx_hashes, severity, chains) of free text: distinct EVM addresses and transaction
    hashes, each in lower case; severity by the largest dollar amount (100 million critical, 10 million
    high, one million medium)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda n: F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<![0-9a-z])(0x[0-9a-f]{{{n}}})(?![0-9a-z])"), F.lit(1)))
    millions = F.array_max(F.transform(F.regexp_extract_all(low, F.lit(r"\$\s?([0-9]+(?:\.[0-9]+)?)\s?(?:m\b|million)"), F.lit(1)), lambda x: x.cast("double")))
    severity = F.when(millions >= 100, "critical").when(millions >= 10, "high").when(millions >= 1, "medium").otherwise("low")
    chains = F.filter(F.array(*(F.lit(c) for c in CHAIN_NAMES)), lambda c: F.array_contains(F.split(low, "[^a-z]+"), c))
    return F.struct(found(40).alias("addresses"), found(64).alias("tx_hashes"), severity.alias("severity"), chains.alias("chains"))
