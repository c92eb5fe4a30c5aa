"""Checks of a case's documents against each other and against its structured data: one table of
violations (case_id, check_id, severity, subject, detail) from many rules.

Every rule is a join or an aggregation by case over tables of what the documents say, so all
cases are judged at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.expressions import CHAIN_NAMES, EXPLORERS, canonical_key

LOW_RATE = 0.05
TOTAL_TOLERANCE, ASK_TOLERANCE = 100, 10
#: A figure in prose is grounded by one within the greater of this and half a per cent.
FIGURE_TOLERANCE, FIGURE_SHARE = 100, 0.005
NOT_EVM = ("tron", "solana", "bitcoin")


def _told(rows: DataFrame, check: str, severity: str | Column, subject: Column, detail: Column) -> DataFrame:
    kind = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("case_id", F.lit(check).alias("check_id"), kind.alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def calibration(leads: DataFrame, rates: DataFrame) -> DataFrame:
    """H.  leads (case_id, address, confidence, sources array<string>), rates (case_id, wilson_lower): leads of high confidence
    need two independent sources, and sit badly with a recovery rate that may be below 5 per cent."""
    high = leads.where(F.lower("confidence") == "high")
    kinds = F.size(F.array_distinct(F.filter(F.transform(F.coalesce("sources", F.array()), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    thin = high.withColumn("n", kinds).where("n < 2")
    low = high.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).join(rates.where(F.col("wilson_lower") < LOW_RATE), "case_id")
    return _told(thin, "H", "critical", F.col("address"), F.concat("n", F.lit(" sources"))).unionByName(_told(low, "H", "warning", F.lit("recovery rate"), F.concat("n", F.lit(" leads"))))


def cross_document(documents: DataFrame, addresses: DataFrame) -> DataFrame:
    """I.  documents (case_id, doc_kind, stated_case, victim, total_usd, incident_date) and addresses (case_id, doc_kind, address):
    identity, victim, date and total (to 100 dollars) agree; no kind of document lacks an address that
    two others name."""
    norm = lambda c: F.nullif(F.lower(F.regexp_replace(F.trim(F.col(c).cast("string")), r"\s+", " ")), F.lit(""))
    said = documents.select("case_id", norm("stated_case").alias("case_id stated"), norm("victim").alias("victim_name"), norm("incident_date").alias("incident_date"), F.col("total_usd").cast("decimal(38,2)").alias("total"))
    fields = ["case_id stated", "victim_name", "incident_date"]
    by_case = said.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(F.col(f"`{c}`")).alias(c) for c in fields), (F.max("total") - F.min("total")).alias("gap")).where("n > 1")
    out = [_told(by_case.where(F.col(f"`{c}`") > 1), "I", "critical", F.lit(c), F.concat(F.col(f"`{c}`"), F.lit(" values"))) for c in fields]
    out.append(_told(by_case.where(F.col("gap") > TOTAL_TOLERANCE), "I", "critical", F.lit("total_usd"), F.col("gap")))
    named = addresses.select("case_id", "doc_kind", canonical_key(F.col("address")).alias("address")).where("address <> ''").distinct()
    shared = named.groupBy("case_id", "address").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kinds = documents.select("case_id", "doc_kind").distinct()
    lacking = shared.join(kinds, "case_id").join(named, ["case_id", "doc_kind", "address"], "left_anti")
    out.append(_told(lacking, "I", "critical", F.col("address"), F.concat(F.col("doc_kind"), F.lit(" lacks it"))))
    return reduce(DataFrame.unionByName, out)


def freeze_asks(listed: DataFrame, asks: DataFrame) -> DataFrame:
    """K.  listed (case_id, issuer, token, address, usd) by the brief, asks (the same) by letters: every ask is listed, with its
    amount to 10 dollars."""
    key = [F.lower(F.trim("issuer")).alias("issuer"), F.upper(F.trim("token")).alias("token"), canonical_key(F.col("address")).alias("address")]
    ours = listed.select("case_id", *key, F.col("usd").alias("listed_usd")).groupBy("case_id", "issuer", "token", "address").agg(F.max("listed_usd").alias("listed_usd"), F.lit(True).alias("there"))
    rows = asks.select("case_id", *key, "usd").where("issuer <> '' AND token <> '' AND address <> ''").join(ours, ["case_id", "issuer", "token", "address"], "left")
    what, apart = F.concat_ws(" ", "issuer", "token", "address"), F.abs(F.col("usd") - F.col("listed_usd"))
    wrong = rows.where(F.col("there").isNull() | (apart > ASK_TOLERANCE))  # one pass: two would make the join twice
    return _told(wrong, "K", "critical", what, F.when(F.col("there").isNull(), "not listed").otherwise(apart.cast("string")))


def explorer_links(links: DataFrame, chains: DataFrame) -> DataFrame:
    """L.  links (case_id, file, url), chains (case_id, address, chain): an EVM address never stands in a link to another family's
    explorer, and one of a known chain only in links to that chain's."""
    hosts = {c: base.split("/")[2] for c, base in EXPLORERS.items()}
    found = links.select("case_id", "file", "url", F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#:]+)", 1)).alias("host"), F.lower(F.regexp_extract("url", "0x[a-fA-F0-9]{40}", 0)).alias("address")).where("address <> ''")
    of = lambda c: (F.col("host") == hosts[c]) | F.endswith("host", F.lit("." + hosts[c]))
    other = reduce(lambda a, b: a | b, [of(c) for c in NOT_EVM if c in hosts], F.lit(False))
    right = reduce(lambda w, c: w.when(F.col("chain") == c, of(c)), hosts, F.when(F.lit(False), True))
    known = chains.select("case_id", canonical_key(F.col("address")).alias("address"), "chain").distinct()
    rows = found.withColumn("other", other).join(known, ["case_id", "address"], "left")
    wrong = rows.where(F.col("other") | (~F.coalesce(right, F.lit(True)))).select("case_id", "file", "address", "host").distinct()
    return _told(wrong, "L", "critical", F.col("address"), F.concat_ws(" ", "file", "host"))


def grounding(prose: DataFrame, addresses: DataFrame, amounts: DataFrame, chains: DataFrame) -> DataFrame:
    """O.  prose (case_id, text) cites only addresses (case_id, address), figures (case_id, usd; within 100 dollars or half a per cent)
    and chains (case_id, chain) of the case's structured data."""
    text = F.coalesce("text", F.lit(""))
    cited = prose.select("case_id", F.explode(F.transform(F.regexp_extract_all(text, F.lit("(0x[a-fA-F0-9]{40})(?![a-fA-F0-9])"), F.lit(1)), F.lower)).alias("address")).distinct()
    loose = cited.join(addresses.select("case_id", canonical_key(F.col("address")).alias("address")).distinct(), ["case_id", "address"], "left_anti")
    figure = F.explode(F.regexp_extract_all(text, F.lit(r"\$\s?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s?[kKmMbB]?)(?![a-zA-Z\d])"), F.lit(1)))
    figures = prose.select("case_id", figure.alias("figure")).withColumn("figure", F.lower(F.regexp_replace("figure", r"[,\s]", "")))
    unit = F.right("figure", F.lit(1))
    usd = F.regexp_replace("figure", "[kmb]$", "").cast("decimal(38,6)") * F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).when(unit == "b", 1_000_000_000).otherwise(1)
    figures = figures.select("case_id", usd.cast("double").alias("cited")).where("cited > 0").distinct()
    near = F.abs(F.col("cited") - F.col("usd").cast("double")) <= F.greatest(F.lit(float(FIGURE_TOLERANCE)), F.col("cited") * FIGURE_SHARE)
    free = figures.alias("f").join(amounts.select(F.col("case_id").alias("case"), "usd"), (F.col("f.case_id") == F.col("case")) & near, "left_anti")
    named = prose.select("case_id", F.explode(F.array_intersect(F.split(F.lower(text), "[^a-z]+"), F.array(*map(F.lit, CHAIN_NAMES)))).alias("chain"))
    strange = named.join(chains.select("case_id", F.lower("chain").alias("chain")).distinct(), ["case_id", "chain"], "left_anti")
    return _told(loose, "O", "critical", F.col("address"), F.lit("no such address")).unionByName(_told(free, "O", "critical", F.col("cited").cast("decimal(38,2)"), F.lit("no such figure"))).unionByName(_told(strange, "O", "critical", F.col("chain"), F.lit("no such chain")))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()
