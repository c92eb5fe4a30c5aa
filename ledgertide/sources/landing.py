"""Landing tables: scans, normalisers, and the merges by which tables are brought up to date.

Live sources land as Parquet, JSON, CSV or XML files; a scan is a filter that reaches the
file reader.  A merge gives the new table: write it beside the old and swap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ledgertide.functions.expressions import csv_guard
from ledgertide.operators.graph import settle

LABEL_SCHEMA = "address string, name string, category string, exchange string, source string, confidence string, notes string, added_at timestamp, valid_from timestamp, valid_until timestamp"
SANCTION_SCHEMA = "address string, chain string, sdn_entry_name string, sdn_entry_id string, listing_date string, removed_at_utc string"


def outflows(transfers: DataFrame, address: Column, start: Column) -> DataFrame:
    return transfers.where((F.col("src") == address) & (F.col("tx_hash") >= start))


def inflows(transfers: DataFrame, address: Column) -> DataFrame:
    return transfers.where(F.col("dst") == address)


def event_logs(logs: DataFrame, topic: str, first: int, last: int) -> DataFrame:
    """Logs with the topic in first place and a block in first..last."""
    return logs.where((F.get("topics", F.lit(0)) == topic) & F.col("block").between(first, last))


def utxo_transfers(txs: DataFrame) -> DataFrame:
    """(tx, inputs array<struct<address>>, outputs array<struct<output_index, address, value>>) -> a row for
    each output: tx, src (the first input's address), dst, output_index, amount."""
    return txs.select("tx", F.get("inputs", F.lit(0))["address"].alias("src"), F.explode("outputs").alias("o")).select("tx", "src", F.col("o.address").alias("dst"), "o.output_index", F.col("o.value").alias("amount"))


def by_precedence(tables: list[DataFrame], key: str) -> DataFrame:
    """The union of tables with the same columns; of equal keys the earliest table's row stays, the
    smallest of its rows where it has several."""
    ranked = reduce(DataFrame.unionByName, (t.withColumn("precedence", F.lit(i)) for i, t in enumerate(tables)))
    rest = [c for c in tables[0].columns if c != key]
    return ranked.groupBy(key).agg(F.min(F.struct("precedence", *rest)).alias("best")).select(key, *(F.col("best")[c].alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of equal keys the row that is last by order."""
    rest = [c for c in old.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return old.unionByName(new).groupBy(*keys).agg(best.alias("best")).select(*(keys), *(F.col("best")[c].alias(c) for c in rest))


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge: a new value replaces the old one unless it's null."""
    fresh = new.select(*keys, *(F.col(c).alias(f"new {c}") for c in new.columns if c not in keys))
    return old.join(fresh, keys, "full").select(*keys, *(F.coalesce(F.col(f"new {c}"), F.col(c)).alias(c) for c in old.columns if c not in keys))


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys the old table doesn't have."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def merge_sanctions(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Entries of both lists; those that are gone from the new one get a removal time once."""
    keys = ["address", "chain", "sdn_entry_id"]
    fresh = new.select(*keys, F.col("sdn_entry_name").alias("new name"), F.col("listing_date").alias("new date"), F.lit(True).alias("present"))
    merged = old.join(fresh, keys, "full")
    return merged.select(*keys, F.coalesce("new name", "sdn_entry_name").alias("sdn_entry_name"), F.coalesce("new date", "listing_date").alias("listing_date"), F.when(~F.coalesce("present", F.lit(False)), F.coalesce("removed_at_utc", now)).alias("removed_at_utc"))


_TOKEN = "struct<chain: string, contract: string, symbol: string, decimals: int>"
CASE_SCHEMA = f"case_id string, seed_address string, chain string, transfers array<struct<transfer_id: string, chain: string, tx_hash: string, block_time: timestamp, from_address: string, to_address: string, token: {_TOKEN}, amount_raw: string, usd_value_at_tx: decimal(28,4)>>"


def read_cases(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """One row a transfer of the case documents (JSON, one document a file, or with ``lines`` one a line);
    none for no paths."""
    cases = spark.read.schema(CASE_SCHEMA).option("multiLine", not lines).json(path) if path else spark.createDataFrame([], CASE_SCHEMA)
    return cases.select("case_id", "seed_address", F.explode_outer("transfers").alias("t")).select("case_id", "seed_address", "t.*")


#: A bundle's file carries the moment of its generation; the stamps are of one width, so they sort by time.
GENERATION = r"BRIEF-(\d{8}T\d{6})"


def generations(files: DataFrame) -> DataFrame:
    """files (path) -> path, case_folder, generation (null for files that belong to none), newest: whether it is of its
    folder's newest generation, or of none."""
    part = lambda n: F.element_at(F.split("path", "/"), n)
    named = files.select("path", part(-2).alias("case_folder"), F.nullif(F.regexp_extract(part(-1), GENERATION, 1), F.lit("")).alias("generation"))
    last = named.groupBy("case_folder").agg(F.max("generation").alias("last"))
    return named.join(last, "case_folder").select("path", "case_folder", "generation", (F.col("generation").isNull() | (F.col("generation") == F.col("last"))).alias("newest"))


def read_newest_cases(spark: SparkSession, root: str) -> DataFrame:
    """Transfers of the newest generation of each case under ``root`` (root/case/...BRIEF-stamp....json).  Only names are
    listed first, so older generations aren't read; files without a stamp aren't bundles."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(root).select("path")
    newest = generations(listed).where("newest AND generation IS NOT NULL")
    return read_cases(spark, [r.path for r in newest.select("path").toLocalIterator()])  # the reader's list of files


def read_labels(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Label seeds (JSON, a list a file, or with ``lines`` one label a line); later paths win over earlier ones
    where an address repeats."""
    tables = [spark.read.schema(LABEL_SCHEMA).option("mode", "DROPMALFORMED").option("multiLine", not lines).json(p) for p in reversed(paths)]
    return by_precedence(tables, "address")


def read_sanctions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SANCTION_SCHEMA).option("header", True).csv(path)


def read_sanctions_xml(spark: SparkSession, path: str, row_tag: str = "sdnEntry") -> DataFrame:
    """Entries of the sanctions XML, one row a listed address."""
    schema = "uid string, lastName string, idList struct<id: array<struct<idType: string, idNumber: string>>>"
    entries = spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)
    ids = entries.select(F.col("uid").alias("sdn_entry_id"), F.col("lastName").alias("sdn_entry_name"), F.explode("idList.id").alias("i"))
    return ids.where("i.idType LIKE 'Digital Currency Address%'").select(F.col("i.idNumber").alias("address"), F.regexp_extract("i.idType", r"- (\w+)$", 1).alias("chain"), "sdn_entry_name", "sdn_entry_id")


def sanctions_entities(records: DataFrame) -> DataFrame:
    """(body JSON of an entity whose properties are lists) -> address, name (the first), entity: a row a wallet."""
    schema = "id string, schema string, properties struct<name: array<string>, publicKey: array<string>>"
    found = records.select(F.from_json("body", schema).alias("e")).where("e.schema = 'CryptoWallet'")
    return found.select(F.explode("e.properties.publicKey").alias("address"), F.get("e.properties.name", F.lit(0)).alias("name"), F.col("e.id").alias("entity")).where("address <> ''")


#: What feeds call the columns that a label needs.
ALIASES = {"address": ("address", "addr", "wallet"), "category": ("category", "type", "tag"), "source": ("source", "provider")}


def attribution_rows(rows: DataFrame) -> DataFrame:
    """Feed rows by whatever names -> address, category, source, outcome: kept, or why it is skipped."""
    pick = lambda to: F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in ALIASES[to] if c in rows.columns), F.lit(None).cast("string")).alias(to)
    named = rows.select(*map(pick, ALIASES))
    return named.withColumn("outcome", F.when(F.col("address").isNull(), "no address").when(F.col("category").isNull(), "no category").otherwise("kept"))


def event_feeds(feeds: dict[str, DataFrame], since: Column) -> DataFrame:
    """Feeds (observed_at, title) as one table with the feed's name, from a time on."""
    return reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("feed"), "observed_at", "title") for name, t in feeds.items())).where(F.col("observed_at") >= since)


def write_transfers_csv(transfers: DataFrame, path: str) -> None:
    """CSV for spreadsheets: no cell can be taken for a formula."""
    text = {f.name for f in transfers.schema.fields if f.dataType.typeName() == "string"}
    transfers.select(*(csv_guard(F.col(c)).alias(c) if c in text else F.col(c) for c in transfers.columns)).write.option("header", True).csv(path)


#: A case with at least this part of all transfers is cut into documents where its rows lie.
LARGE_PART = 100


def documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(case_id, seed_address, t) of one task -> case_id, seed_address, transfers: each case's rows in lists of ``most``, but
    for its last.  No more than that many rows of a case, and a batch, are held."""
    held: dict = {}
    columns = ["case_id", "seed_address", "transfers"]

    def full(of: tuple, rows: pa.Array, size: int) -> pa.RecordBatch:
        ends = pa.array([*range(0, len(rows), size), len(rows)], pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(ends) - 1) for k in of), pa.ListArray.from_arrays(ends, rows)], columns)

    for batch in batches:
        codes = [batch.column(c).dictionary_encode(null_encoding="encode") for c in range(2)]
        place = np.int64(len(codes[1].dictionary)) * codes[0].indices.to_numpy() + codes[1].indices.to_numpy()
        order = np.argsort(place, kind="stable")
        firsts = np.flatnonzero(np.append(True, np.diff(place[order]) != 0)) if len(order) else order
        for rows in np.split(order, firsts[1:]) if len(order) else ():
            of = tuple(batch.column(c)[int(rows[0])] for c in range(2))
            name = tuple(k.as_py() for k in of)
            parts = held.setdefault(name, (of, []))[1]
            parts.append(batch.column(2).take(pa.array(rows)))
            n = sum(map(len, parts))
            if n >= most:
                whole = pa.concat_arrays(parts)
                yield full(of, whole.slice(0, n - n % most), most)
                held[name] = (of, [whole.slice(n - n % most)] if n % most else [])
    for of, parts in held.values():
        if parts:
            yield full(of, pa.concat_arrays(parts), most)


def write_cases(transfers: DataFrame, path: str, most: int = 1000) -> None:
    """A packed JSON document a case and line, with its transfers inside; ``read_cases`` with lines reads it again.
    A case of more than ``most`` transfers takes several documents of about that many, so that none holds a
    whole busy case; those of the largest cases are cut where their rows lie, so that these aren't shuffled."""
    key, rest = ["case_id", "seed_address"], [c for c in transfers.columns if c not in ("case_id", "seed_address")]
    sizes = settle(transfers.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).toDF("of_case", "of_seed", "n"))  # a row a case
    own = F.col("case_id").eqNullSafe(F.col("of_case")) & F.col("seed_address").eqNullSafe(F.col("of_seed"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    is_large = (F.col("n") > most) & (F.col("n") * LARGE_PART >= total)  # LARGE_PART cases at most
    large = F.broadcast(sizes.where(is_large))
    inside = large.agg(F.sum("n")).first()[0] or 0
    made = []
    if inside:
        rows = (transfers if inside == total else transfers.join(large, own, "left_semi")).select(*key, F.struct(*rest).alias("t"))
        kinds = StructType([*(StructField(k, rows.schema[k].dataType) for k in key), StructField("transfers", ArrayType(rows.schema["t"].dataType))])
        made.append(rows.mapInArrow(lambda batches: documents(batches, most), kinds))
    if inside < total or not total:
        # a small table of busy cases, counted before it is broadcast, so that no case is a task of the join
        busy = sizes.where((F.col("n") > most) & ~is_large).select("of_case", "of_seed", F.ceil(F.col("n") / most).alias("n_parts"))
        busy = F.broadcast(busy) if busy.count() <= 50_000 else busy
        sized = (transfers.join(large, own, "left_anti") if inside else transfers).join(busy, own, "left")
        dealt = sized.withColumn("part", F.pmod(F.xxhash64(*rest), "n_parts"))
        made.append(dealt.groupBy(*key, "part").agg(F.collect_list(F.struct(*rest)).alias("transfers")).drop("part"))  # a document's own
    reduce(DataFrame.unionByName, made).write.option("compression", "gzip").json(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """The same rows as CSV and as JSON lines, in two folders."""
    write_transfers_csv(findings, f"{path}/csv")
    findings.write.json(f"{path}/json")


def write_aggregate(matched: DataFrame, path: str) -> None:
    """What reached the perpetrators (matched: case_id, wallet, perpetrator, symbol, contract, amt, usd) as JSON: ``summary`` (one
    document), ``by_asset``, ``by_victim_wallet`` and ``matched_transfers``, a line for each, and ``report``, the assets
    as rows of a markdown table.  Amounts are text, so nothing is rounded."""
    unpriced = F.bool_or(F.col("usd").isNull())
    by_asset = matched.groupBy("symbol", "contract").agg(F.count(F.lit(1)).alias("transfer_count"), F.sum("amt").cast("string").alias("total_amount"), F.sum("usd").cast("string").alias("total_usd"), unpriced.alias("has_unpriced_transfers"))
    matched.agg(F.count_distinct("case_id").alias("cases_examined"), F.count_distinct("perpetrator").alias("perpetrators"), F.sum("usd").cast("string").alias("total_usd"), F.count(F.lit(1)).alias("transfer_count")).write.json(f"{path}/summary")
    by_asset.write.json(f"{path}/by_asset")
    matched.groupBy("wallet").agg(F.sum("usd").cast("string").alias("total_usd")).write.json(f"{path}/by_victim_wallet")
    matched.withColumn("amt", F.col("amt").cast("string")).withColumn("usd", F.col("usd").cast("string")).write.json(f"{path}/matched_transfers")
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|\\])", r"\\$1")
    shown = "symbol string, contract string, transfer_count long, total_amount string, total_usd string"
    by_asset = matched.sparkSession.read.schema(shown).json(f"{path}/by_asset")  # as written: the transfers aren't gone through again
    by_asset.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in ("symbol", "contract", "transfer_count", "total_amount", "total_usd"))), F.lit(" |")).alias("value")).write.text(f"{path}/report")


def write_dormant(holdings: DataFrame, explorer_url: Column, path: str) -> None:
    """A JSON document a dormant address (address, chain), with its total and its holdings inside (holdings: symbol,
    decimal_amount, usd_value, pricing_error); amounts are text."""
    rows = holdings.withColumn("explorer_url", explorer_url)
    one = F.struct("symbol", F.col("decimal_amount").cast("string").alias("decimal_amount"), F.col("usd_value").cast("string").alias("usd_value"), "pricing_error")
    found = rows.groupBy("address", "chain", "explorer_url").agg(F.sum("usd_value").cast("string").alias("total_usd"), F.sort_array(F.collect_list(one)).alias("holdings"))  # an address's own
    found.write.json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Audit rows are only ever added."""
    rows.write.mode("append").parquet(path)


def capped_candidates(new: DataFrame, old: DataFrame, keys: list[str], day: str, order: list, cap: int) -> DataFrame:
    """New candidates, at most ``cap`` a day (the feature's own daily cap)."""
    place = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return absent(new, old, keys).withColumn("place", place).where(F.col("place") <= cap).drop("place")
