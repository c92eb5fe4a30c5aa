"""From raw documents to token files: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of documents, and any further ones that docs has.
Rows are judged one by one: repeated doc_ids, null doc_ids and repeated rows stay several
rows wherever nothing below says otherwise.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgertide.llm import decontaminate, host_rules, mixing, ngram_jaccard, token_output
from ledgertide.llm.shared import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's record, reject go.

    Null, empty and blank texts have no words and go.  A null source is no host: such a
    document goes by its own failures only.  Copies get one verdict if they share a source.
    """
    return host_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: one with the smallest doc_id, a null
    one only where there is no other; of repeated rows with that doc_id one.  Null, empty
    and blank texts are near nothing and all stay."""
    return ngram_jaccard.keep_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each by its own text whatever its doc_id; null and
    empty texts hold none, nor does any text a null or empty item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by its source's mean repetition, in random order.  A null source
    counts as ''; rows that share doc_id and source are drawn alike; texts don't matter."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of every copy, read back from the shards, which
    keep the order that the stage before dealt.  A null or empty text is the end id alone."""
    return token_output.token_output(docs, by_id=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("tokens", tokens),
]

#: SQL can't encode tokens; tests hold the stages against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
