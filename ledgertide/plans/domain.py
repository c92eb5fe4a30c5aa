"""The driver's tables as fund-flow tables, in both engines.

Customers and suppliers share one account space; an order line is a transfer from its
order's customer to its supplier.  Money is exact decimal until the last step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of transfers; rows that tie in all of it are the same.
ORD = ["block_time", "tx_hash", "log_index", "token", "dst", "usd", "amt"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of the larger table in one task of a join or grouping by transaction.
ROWS_A_TASK = 400_000


def tasks_for(spark: SparkSession, n_rows: int) -> int | None:
    """As many tasks as a table of n_rows needs, so that a task holds no more as tables grow, and one a core at least; None
    for a table of one task.  The session's own number doesn't bound a task: Spark merges its partitions
    by their bytes, up to tens of megabytes packed."""
    tasks = n_rows // ROWS_A_TASK
    return max(tasks, spark.sparkContext.defaultParallelism) if tasks > 1 else None


def dealt(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows by key over ``tasks_for`` a table of n_rows; small tables are left to the session."""
    tasks = tasks_for(rows.sparkSession, n_rows)
    return rows.repartition(tasks, key) if tasks else rows


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """chain, tx_hash, log_index, block_time, src, dst, token, amt, usd, case_id.  Lines and orders meet in more tasks as
    they grow, and what is grouped by transaction afterwards stays there."""
    lines = load(spark, sf, "lineitem")
    n = lines.count()  # of the files' footers
    lines = lines.selectExpr(
        "l_orderkey", "l_linenumber AS log_index", "l_shipdate AS block_time", "l_suppkey AS dst", "l_partkey AS token", "l_returnflag AS chain",
        "CAST(l_quantity AS DECIMAL(12,2)) AS amt", "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS usd",
    )
    orders = load(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS src", "o_orderpriority AS case_id")
    lines, orders = dealt(lines, "l_orderkey", n), dealt(orders, "o_orderkey", n)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).where("src <> dst")
    return joined.select("chain", F.col("l_orderkey").alias("tx_hash"), "log_index", "block_time", "src", "dst", "token", "amt", "usd", "case_id")


T = """t AS (
  SELECT l_returnflag AS chain, l_orderkey AS tx_hash, l_linenumber AS log_index, l_shipdate AS block_time, o_custkey AS src, l_suppkey AS dst,
         l_partkey AS token, CAST(l_quantity AS DECIMAL(12,2)) AS amt,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS usd, o_orderpriority AS case_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey)"""

_CATEGORY = "CASE WHEN s_suppkey % 11 = 0 THEN 'exchange' WHEN s_suppkey % 7 = 0 THEN 'bridge' WHEN s_suppkey % 13 = 0 THEN 'mixer' ELSE 'defi' END"
_TIER = "CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """address, name, category, confidence, added_at, valid_from, valid_until (null: open)."""
    at = "timestampadd(DAY, CAST({0} AS INT), TIMESTAMP_NTZ '{1}')"
    return load(spark, sf, "supplier").where("s_suppkey % 2 = 1 OR s_suppkey % 11 = 0").selectExpr(
        "s_suppkey AS address", "s_name AS name", f"{_CATEGORY} AS category", f"{_TIER} AS confidence",
        f"{at.format('s_suppkey * 11 % 900', '1995-01-01 00:00:00')} AS added_at",
        f"CASE WHEN s_suppkey % 4 = 1 THEN {at.format('s_suppkey * 5 % 300', '1995-06-01 00:00:00')} END AS valid_from",
        f"CASE WHEN s_suppkey % 5 <> 0 THEN {at.format('s_suppkey * 7 % 700', '1999-01-01 00:00:00')} END AS valid_until",
    )


L = f"""labels AS (
  SELECT s_suppkey AS address, s_name AS name, {_CATEGORY} AS category, {_TIER} AS confidence,
         TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey * 11 % 900 AS INTEGER)) AS added_at,
         CASE WHEN s_suppkey % 4 = 1 THEN TIMESTAMP '1995-06-01' + to_days(CAST(s_suppkey * 5 % 300 AS INTEGER)) END AS valid_from,
         CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '1999-01-01' + to_days(CAST(s_suppkey * 7 % 700 AS INTEGER)) END AS valid_until
  FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 11 = 0)"""

_RISK = "CASE s_suppkey % 3 WHEN 0 THEN 'ofac_sanctioned' WHEN 1 THEN 'ransomware' ELSE 'drainer' END"


def high_risk(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").where("s_suppkey % 17 = 0").selectExpr("s_suppkey AS address", f"{_RISK} AS risk_category", "CAST(1 + s_suppkey % 3 AS INT) AS severity")


R = f"high_risk AS (SELECT s_suppkey AS address, {_RISK} AS risk_category, CAST(1 + s_suppkey % 3 AS INTEGER) AS severity FROM supplier WHERE s_suppkey % 17 = 0)"


def issuers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS token", "p_brand AS issuer", "CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'limited' ELSE 'no' END AS freeze_capability")


I = "issuers AS (SELECT p_partkey AS token, p_brand AS issuer, CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'limited' ELSE 'no' END AS freeze_capability FROM part WHERE p_partkey % 3 = 0)"


def letters(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").selectExpr("o_orderkey AS letter_id", "o_custkey AS case_id", "o_orderpriority AS issuer", "o_orderstatus AS tier", "CAST(o_totalprice AS DECIMAL(20,2)) AS requested_usd", "o_orderdate AS sent_at")


_OUTCOME = "CASE l_linenumber WHEN 1 THEN 'full_freeze' WHEN 2 THEN 'declined' WHEN 3 THEN 'partial_freeze' WHEN 4 THEN 'returned' WHEN 5 THEN 'acknowledged' ELSE 'no_response' END"
_WINS = "('full_freeze', 'partial_freeze', 'returned')"


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").where("l_returnflag = 'A'").selectExpr(
        "l_orderkey AS letter_id", f"{_OUTCOME} AS outcome_type", "l_shipdate AS observed_at", f"CASE WHEN {_OUTCOME} IN ('full_freeze', 'partial_freeze') THEN CAST(l_extendedprice AS DECIMAL(20,2)) END AS frozen_usd",
        f"CASE WHEN {_OUTCOME} = 'returned' THEN CAST(l_extendedprice AS DECIMAL(20,2)) END AS returned_usd", "l_partkey AS seq",
    )


O = f"""letters AS (
  SELECT o_orderkey AS letter_id, o_custkey AS case_id, o_orderpriority AS issuer, o_orderstatus AS tier,
         CAST(o_totalprice AS DECIMAL(20,2)) AS requested_usd, o_orderdate AS sent_at FROM orders),
outcomes AS (
  SELECT l_orderkey AS letter_id, {_OUTCOME} AS outcome_type, l_shipdate AS observed_at,
         CASE WHEN {_OUTCOME} IN ('full_freeze', 'partial_freeze') THEN CAST(l_extendedprice AS DECIMAL(20,2)) END AS frozen_usd,
         CASE WHEN {_OUTCOME} = 'returned' THEN CAST(l_extendedprice AS DECIMAL(20,2)) END AS returned_usd, l_partkey AS seq
  FROM lineitem WHERE l_returnflag = 'A')"""

#: Strength of outcomes, the strongest first.
STRENGTH = {"full_freeze": 1, "returned": 2, "partial_freeze": 3, "acknowledged": 4, "declined": 5, "no_response": 6}
WINS = ("full_freeze", "partial_freeze", "returned")
STRENGTH_SQL = "CASE outcome_type WHEN 'full_freeze' THEN 1 WHEN 'returned' THEN 2 WHEN 'partial_freeze' THEN 3 WHEN 'acknowledged' THEN 4 WHEN 'declined' THEN 5 ELSE 6 END"


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """watch_id, taken_at, usd_value, tx_count."""
    return load(spark, sf, "events").selectExpr("user_id AS watch_id", "ts AS taken_at", "event_id", "CAST(value AS DECIMAL(20,2)) AS usd_value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS tx_count", "event_type")


S = """snapshots AS (
  SELECT user_id AS watch_id, ts AS taken_at, event_id, CAST(value AS DECIMAL(20,2)) AS usd_value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tx_count, event_type FROM events)"""
