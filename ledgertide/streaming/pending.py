"""Pending transactions: a stream source that replays the frames of a subscription as they landed, and
what they say about watched addresses.

A frame is one line of text.  Frames land in files whose names sort by time; offsets are
names of files, so a batch can be read again after a failure and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgertide.functions import abi
from ledgertide.functions.expressions import canonical_key

FRAME_ROWS = "file string, line long, frame string"
UNCONFIRMED = "unconfirmed: it may be dropped or replaced"


class FramesFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FramesReader(DataSourceStreamReader):
    """Offsets: the last file that was read.  A batch has a partition for each later file."""

    def __init__(self, options: dict):
        self.files, self.folder = fs.FileSystem.from_uri(options["path"])

    def _names(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FramesFile(f"{self.folder}/{n}") for n in self._names() if start["file"] < n <= end["file"]]

    def read(self, partition: FramesFile) -> Iterator[tuple]:
        name = partition.path.rpartition("/")[2]
        with self.files.open_input_stream(partition.path) as stream:
            rest, number = b"", 0
            while piece := stream.read(1 << 20):
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    yield (name, number, line.decode("utf-8", "replace"))
                    number += 1
            if rest:
                yield (name, number, rest.decode("utf-8", "replace"))

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    """``spark.readStream.format("frames").load(uri of a folder)``; register it with ``frames``."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME_ROWS

    def streamReader(self, schema) -> FramesReader:  # noqa: N802
        return FramesReader(self.options)


def frames(spark: SparkSession, uri: str) -> DataFrame:
    """A stream of file, line, frame; a file must be whole when it appears (moved into the folder)."""
    spark.dataSource.register(Frames)
    return spark.readStream.format("frames").load(uri)


def _quantity(text: Column) -> Column:
    """A hexadecimal (0x) or decimal quantity as digits; null for anything else."""
    wide = F.lpad(F.get(F.regexp_extract_all(text, F.lit("^0x([0-9a-fA-F]{1,64})$"), F.lit(1)), F.lit(0)), 64, "0")
    return F.coalesce(abi.number(F.unhex(wide)), F.get(F.regexp_extract_all(text, F.lit(r"^(\d{1,78})$"), F.lit(1)), F.lit(0)))


def pending_alerts(frames_: DataFrame, watched: DataFrame, chain: str) -> DataFrame:
    """frames_ (frame, any others) -> the others, address, counterparty, chain, tx_hash, value_wei (digits), direction, settled
    (false), caveat of the pending transactions that touch a watched address (column address).

    A transaction to a watched address is inbound, also if it comes from one; else one from a
    watched address is outbound.  A notification that is only a hash was filtered by the
    server, so it is a hit of unknown side.  Acknowledgements and broken frames are skipped.
    """
    others = [c for c in frames_.columns if c != "frame"]
    result = F.get_json_object("frame", "$.params.result")
    inside = lambda name: F.get_json_object("frame", f"$.params.result.{name}")
    rows = frames_.select(*others, result.alias("result"), inside("from").alias("from"), inside("to").alias("to"), inside("hash").alias("hash"), inside("value").alias("value"))
    rows = rows.where(F.col("result").isNotNull()).withColumn("bare", ~F.startswith("result", F.lit("{")) & ~F.startswith("result", F.lit("[")))
    keys = watched.select(canonical_key(F.col("address")).alias("key")).where("key <> ''").distinct().withColumn("hit", F.lit(True))
    side = lambda name: keys.select(F.col("key").alias(f"{name}_key"), F.col("hit").alias(f"{name}_hit"))
    rows = rows.withColumn("to_key", canonical_key(F.col("to"))).withColumn("from_key", canonical_key(F.col("from"))).join(side("to"), "to_key", "left").join(side("from"), "from_key", "left")
    direction = F.when(F.col("bare"), "unknown").when(F.col("to_hit"), "inbound").when(F.col("from_hit"), "outbound")
    rows = rows.withColumn("direction", direction).where("direction IS NOT NULL")
    inbound, known = F.col("direction") == "inbound", F.col("direction") != "unknown"
    other = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        *others, F.when(known, F.when(inbound, F.col("to")).otherwise(F.col("from"))).alias("address"), F.when(known, F.when(inbound, other("from")).otherwise(other("to"))).alias("counterparty"), F.lit(chain).alias("chain"),
        F.when(known, F.coalesce("hash", F.lit(""))).otherwise(F.col("result")).alias("tx_hash"), F.when(known, _quantity(F.col("value"))).alias("value_wei"), "direction", F.lit(False).alias("settled"), F.lit(UNCONFIRMED).alias("caveat"),
    )
