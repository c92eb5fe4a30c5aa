"""What the training-data operators share: tables, scratch tables, guarded broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table with at most so many (narrow) rows may be broadcast; see ``join_small``.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package from where the driver has it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Where that is unset, local
    mode (as in tests) sets a temporary folder as such; a cluster must name a shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if re.match(r"\w+:", root) else "file://" + root.rstrip("/")


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside lose their shuffle files when they end, not when
    the driver happens to collect garbage; right for what is run once."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run, written under the shared folder to cut lineage: a lost
    executor costs a read of them, not their computation.  ``drop`` deletes what is no
    longer read; the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._at_exit)

    def end(self) -> None:
        """Deletes all tables."""
        remove(self.spark, self.path)

    def _at_exit(self) -> None:
        try:
            self.end()
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with freeing_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """left join right, broadcast only if right (a saved narrow table) was counted and has
    at most ``limit`` rows; beyond that an ordinary join, whose skew AQE splits."""
    return left.join(F.broadcast(right) if right.count() <= limit else right, on, how)


def fold_ascii(text: Column) -> Column:
    """A-Z as a-z, all else unchanged (lower() would change more)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition that is sorted by ``keys`` (which must not be
    null): each holds the groups that ended within about ``rows`` rows.  One group is the
    least it holds, so groups must be bounded."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts([whole[k].to_numpy() for k in keys])
        cut = int(starts[-1])
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut).combine_chunks()
            held = [b for b in rest.to_batches()]
            count = rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
