"""Files: each query writes what the tables say in a format of the outside world, under the shared
folder, and reads it back with the library's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgertide.functions import expressions as X
from ledgertide.operators.graph import shared_root
from ledgertide.plans.domain import L, T, labels, load, transfers
from ledgertide.plans.registry import query
from ledgertide.sources import landing


#: A file of XML is read by one task.
ENTRIES_A_FILE = 50_000


def folder(spark, name):
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("s21_case_scan", f"WITH {T} SELECT case_id, chain, count(*) AS n, CAST(sum(CAST(usd AS DECIMAL(28,4))) AS DOUBLE) AS usd, min(block_time) AS first_at FROM t GROUP BY ALL")
def s21(spark, sf):
    """Case documents with their transfers inside, written and scanned again."""
    rows = transfers(spark, sf).select(
        "case_id", F.lit("seed").alias("seed_address"), F.concat_ws("-", "tx_hash", "log_index", "token").alias("transfer_id"), "chain", F.col("tx_hash").cast("string").alias("tx_hash"), F.col("block_time").cast("timestamp").alias("block_time"),
        F.col("src").cast("string").alias("from_address"), F.col("dst").cast("string").alias("to_address"), F.struct("chain", F.col("token").cast("string").alias("symbol")).alias("token"), F.col("usd").cast("decimal(28,4)").alias("usd_value_at_tx"),
    )
    at = folder(spark, "cases")
    landing.write_cases(rows, at)
    back = landing.read_cases(spark, at, lines=True)
    return back.groupBy("case_id", "chain").agg(F.count(F.lit(1)).alias("n"), F.sum("usd_value_at_tx").cast("double").alias("usd"), F.min("block_time").cast("timestamp_ntz").alias("first_at"))


@query("s29_sanctions_xml", """SELECT 'addr' || c_custkey AS address, CASE c_custkey % 2 WHEN 0 THEN 'XBT' ELSE 'ETH' END AS chain, c_name AS sdn_entry_name, CAST(c_custkey AS VARCHAR) AS sdn_entry_id FROM customer WHERE c_custkey % 3 > 0
  UNION ALL SELECT 'other' || c_custkey, 'USDT', c_name, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 = 0""")
def s29(spark, sf):
    """The sanctions list's XML: an entry has no, one or two wallets among its papers."""
    one = lambda kind, number: F.struct(kind.alias("idType"), number.alias("idNumber"))
    key = F.col("c_custkey")
    wallet = one(F.concat(F.lit("Digital Currency Address - "), F.when(key % 2 == 0, "XBT").otherwise("ETH")), F.concat(F.lit("addr"), key))
    ids = F.array(one(F.lit("Passport"), F.concat(F.lit("P"), key)), F.when(key % 3 > 0, wallet), F.when(key % 5 == 0, one(F.lit("Digital Currency Address - USDT"), F.concat(F.lit("other"), key))))
    entries = load(spark, sf, "customer").select(key.cast("string").alias("uid"), F.col("c_name").alias("lastName"), F.struct(F.filter(ids, lambda x: x.isNotNull()).alias("id")).alias("idList"))
    at = folder(spark, "sdn")
    entries.write.format("xml").option("rowTag", "sdnEntry").option("rootTag", "sdnList").option("maxRecordsPerFile", ENTRIES_A_FILE).save(at)
    return landing.read_sanctions_xml(spark, at)


@query("k12_sanctions_merge", """WITH e AS (SELECT 'addr' || c_custkey AS address, c_custkey AS k, c_name AS name FROM customer)
  SELECT address, 'eth' AS chain, CAST(k AS VARCHAR) AS sdn_entry_id, CASE WHEN k % 4 <> 1 THEN upper(name) ELSE name END AS sdn_entry_name, CASE k % 4 WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'before' ELSE 'now' END END AS removed_at_utc FROM e""")
def k12(spark, sf):
    """Also S30: two lists as CSV; a fourth is only in the old one, a fourth only in the new one."""
    rows = load(spark, sf, "customer").select(F.concat(F.lit("addr"), "c_custkey").alias("address"), F.lit("eth").alias("chain"), F.col("c_name").alias("sdn_entry_name"), F.col("c_custkey").cast("string").alias("sdn_entry_id"), F.lit("2020-01-01").alias("listing_date"), F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 4 == 1), "before").alias("removed_at_utc"), "c_custkey")
    old, new = folder(spark, "sdn-old"), folder(spark, "sdn-new")
    rows.where("c_custkey % 4 <> 2").drop("c_custkey").write.option("header", True).csv(old)
    rows.where("c_custkey % 4 <> 1").withColumn("sdn_entry_name", F.upper("sdn_entry_name")).drop("c_custkey").write.option("header", True).csv(new)
    merged = landing.merge_sanctions(landing.read_sanctions(spark, old), landing.read_sanctions(spark, new), F.lit("now"))
    return merged.select("address", "chain", "sdn_entry_id", "sdn_entry_name", "removed_at_utc")


@query("s23_label_seeds", f"""WITH {L}, later AS (SELECT address, 'later ' || name AS name FROM labels WHERE address % 4 = 1) SELECT CAST(address AS VARCHAR) AS address, coalesce(later.name, labels.name) AS name, category FROM labels LEFT JOIN later USING (address)""")
def s23(spark, sf):
    """Two seed files of labels, the later of which wins."""
    rows = labels(spark, sf).select(F.col("address").cast("string").alias("address"), "name", "category", (F.col("address") % 4 == 1).alias("again"))
    first, second = folder(spark, "labels-first"), folder(spark, "labels-second")
    rows.drop("again").write.json(first)
    rows.where("again").select("address", F.concat(F.lit("later "), "name").alias("name"), "category").write.json(second)
    return landing.read_labels(spark, [first, second], lines=True).select("address", "name", "category")


@query("k4_aggregate_report", f"""WITH {T} SELECT CAST(token AS VARCHAR) AS symbol, CAST(count(*) AS BIGINT) AS transfer_count, CAST(sum(usd) AS DOUBLE) AS total_usd, bool_or(token % 10 = 0) AS unpriced FROM t WHERE token % 10 <> 0 GROUP BY token
  UNION ALL SELECT CAST(token AS VARCHAR), count(*), NULL, true FROM t WHERE token % 10 = 0 GROUP BY token""")
def k4(spark, sf):
    """The report's documents as they come back: totals by asset; every tenth token has no price."""
    rows = transfers(spark, sf).select("case_id", F.col("src").cast("string").alias("wallet"), F.col("dst").cast("string").alias("perpetrator"), F.col("token").cast("string").alias("symbol"), F.col("token").cast("string").alias("contract"), "amt", F.when(F.col("token") % 10 != 0, F.col("usd")).alias("usd"))
    at = folder(spark, "aggregate")
    landing.write_aggregate(rows, at)
    back = spark.read.json(f"{at}/by_asset")
    return back.select("symbol", F.col("transfer_count").cast("long").alias("transfer_count"), F.col("total_usd").cast("double").alias("total_usd"), F.col("has_unpriced_transfers").alias("unpriced"))


@query("k5_dormant_report", """WITH h AS (SELECT l_suppkey AS address, l_partkey AS token, sum(CAST(l_quantity AS DECIMAL(12,2))) AS amount FROM lineitem GROUP BY ALL)
  SELECT CAST(address AS VARCHAR) AS address, CAST(count(*) AS BIGINT) AS n_holdings, CAST(sum(amount * 2) FILTER (WHERE token % 3 > 0) AS DOUBLE) AS total_usd, count(*) FILTER (WHERE token % 3 = 0) AS n_unpriced, 'https://etherscan.io/address/' || address AS explorer_url FROM h GROUP BY address""")
def k5(spark, sf):
    """Dormant addresses with their holdings inside, as documents; a third of the tokens can't be priced."""
    held = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("address"), F.col("l_partkey").alias("token")).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("decimal_amount"))
    held = held.select("address", F.lit("ethereum").alias("chain"), F.col("token").cast("string").alias("symbol"), "decimal_amount", F.when(F.col("token") % 3 > 0, F.col("decimal_amount") * 2).alias("usd_value"), F.when(F.col("token") % 3 == 0, "no price").alias("pricing_error"))
    at = folder(spark, "dormant")
    landing.write_dormant(held, X.explorer_url(F.col("chain"), F.col("address")), at)
    back = spark.read.json(at)
    one = F.explode("holdings").alias("h")
    return back.select("address", "explorer_url", one).groupBy("address", "explorer_url").agg(F.count(F.lit(1)).alias("n_holdings"), F.sum(F.col("h.usd_value").cast("decimal(30,4)")).cast("double").alias("total_usd"), F.count("h.pricing_error").alias("n_unpriced"))
