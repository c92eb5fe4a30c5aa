"""Operator 6, token-id output: a wavelet matrix per shard (see ``wavelet``).

Texts are ranged by doc_id with one shuffle; each task encodes its sorted texts and
writes files of about ``tokens_per_shard`` ids, under names of its own attempt, so that
a lost or repeated task never touches another's files; the manifest that the successful
attempts return says which files count.  Reading goes by Spark's binaryFile source.

The tokenizers library encodes.  Word-level BPE (white space dropped, every unit ending
in a marked token) is encoded once for each distinct unit that a worker meets and then
spread over its places; other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, NOT_SPACE, Slice, byte_class, runs, slices
from ledgertide.llm.shared import Scratch, table
from ledgertide.llm.wavelet import WaveletShard, encode

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
TOKENS_PER_SHARD = 2_000_000
ENCODE_BYTES = 6 << 20
#: A worker keeps the ids of so many units between slices, and then begins anew.
KNOWN_UNITS = 400_000
#: Words with these bytes go to the whole tokenizer: its normaliser, contractions or
#: special tokens may change them in ways that their parts don't show.
HARD = byte_class((0x80, 0xFF), (0x00, 0x1F), (0x7F, 0x7F), (0x27, 0x27), (0x3C, 0x3C))
_kind = np.full(256, 3, np.uint8)
_kind[0x61:0x7B] = 1
_kind[0x41:0x5B] = 1
_kind[0x30:0x3A] = 2
#: The pre-tokenizer for which distinct units may be encoded apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of the texts of a slice, each with the end id."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.end_id = end_id
        self.bits = max(1, (max(self.full.get_vocab_size(), end_id + 1) - 1).bit_length())
        spec = json.loads(self.full.to_str())
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_unit = spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and splits[0].get("pattern") == {"Regex": WORD_PATTERN} and splits[0].get("behavior") == "Removed"
        if self.by_unit:
            self.plain = Tokenizer(self.full.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(1 << self.bits, bool)
            for token, i in self.full.get_vocab().items():
                self.last[i] = token.endswith("</w>")
            self.zero = self.full.token_to_id("0</w>")
            self.forget()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def hard_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of single words, by the whole tokenizer.  Words are joined by the digit 0, which is a
        unit of its own and whose id parts them again; a word that has a 0 or might be a special
        token, or a run whose parts don't add up, is encoded word by word."""
        out: list = [None] * len(words)
        joined = [i for i, w in enumerate(words) if "0" not in w and "<" not in w]
        runs_ = [joined[k : k + 250] for k in range(0, len(joined), 250)]
        for run, ids in zip(runs_, self.whole([" 0 ".join([words[i] for i in run]) for run in runs_]), strict=True):
            ids = np.array(ids, np.int32)
            cuts = np.flatnonzero(ids == self.zero)
            if len(cuts) == len(run) - 1:
                for i, a, b in zip(run, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.whole([words[i] for i in rest]), strict=True):
            out[i] = np.array(ids, np.int32)
        return out

    def units(self, units: list[bytes]) -> np.ndarray:
        """Where the units' ids lie in the pool; units that it doesn't have yet are encoded."""
        if len(self.place) > KNOWN_UNITS or self.held > 4 * KNOWN_UNITS:
            self.forget()
        new = [u for u in units if u not in self.place]
        if new:
            hard = self._hard(new)
            rest = [u for u, h in zip(new, hard.tolist(), strict=True) if h]
            plain = [u for u, h in zip(new, hard.tolist(), strict=True) if not h]
            for at in range(0, len(plain), 2000):
                part = plain[at : at + 2000]
                ids = np.array(self.plain.encode_batch_fast([" ".join([u.decode() for u in part])], add_special_tokens=False)[0].ids, np.int32)
                stops = np.flatnonzero(self.last[ids]) + 1
                if len(stops) == len(part):
                    self._keep(part, ids, np.diff(stops, prepend=0))
                else:
                    rest += part
            for at in range(0, len(rest), 5000):
                part = rest[at : at + 5000]
                each = self.hard_words([u.decode("utf-8", "replace") for u in part])
                self._keep(part, np.concatenate(each).astype(np.int32), np.array([len(x) for x in each]))
            self.begin, self.size, self.pool = (np.concatenate(x) for x in (self.begins, self.sizes, self.pools))
            self.begins, self.sizes, self.pools = [self.begin], [self.size], [self.pool]
        return np.array([self.place[u] for u in units], np.int64)

    def forget(self) -> None:
        """An empty pool; the end id has place 0."""
        self.place: dict[bytes, int] = {}
        self.begin, self.size, self.pool = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.int32)
        self.begins, self.sizes, self.pools = [self.begin], [self.size], [self.pool]
        self.held = 1

    def _keep(self, units: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.place) + 1
        self.place.update(zip(units, range(first, first + len(units)), strict=True))
        self.begins.append(self.held + np.cumsum(lengths) - lengths)
        self.sizes.append(lengths)
        self.pools.append(ids)
        self.held += len(ids)

    @staticmethod
    def _hard(units: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in units])
        seen = np.concatenate([[0], np.cumsum(HARD[np.frombuffer(b"".join(units), np.uint8)])])
        ends = np.cumsum(lengths)
        return seen[ends] > seen[ends - lengths]

    def encode(self, piece: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts end to end, and where each text's ids end."""
        if not self.by_unit:
            each = self.whole([piece.bytes_of(i).decode("utf-8", "replace") for i in range(len(piece))])
            ids = np.array([t for x in each for t in [*x, self.end_id]], np.int64)
            return ids, np.cumsum([len(x) + 1 for x in each])
        starts, ends, _ = runs(piece, NOT_SPACE)
        n = len(piece.data)
        if len(starts):
            hard_bytes = np.concatenate([[0], np.cumsum(HARD[piece.data])])
            hard = hard_bytes[ends] > hard_bytes[starts]
            whole = np.repeat(hard, ends - starts)  # for the bytes inside words
            inside = NOT_SPACE[piece.data]
            kept = piece.data[inside]
            kind = _kind[kept]
            opens = np.empty(len(kept), bool)
            opens[0] = True
            opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            opens &= ~whole
            firsts = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
            opens[firsts] = True
            begins = np.flatnonzero(opens)
            offsets = np.append(begins, len(kept)).astype(np.int64)
            array = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.where(whole, kept, FOLD[kept]))])
            coded = array.dictionary_encode()
            index = self.units(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            position = np.concatenate([[0], np.cumsum(inside)])
            text_units = np.searchsorted(begins, position[piece.offsets])
        else:
            index, text_units = np.zeros(0, np.int64), np.zeros(len(piece) + 1, np.int64)
        index = np.insert(index, text_units[1:], 0)
        spread = self.size[index]
        stops = np.cumsum(spread)
        ids = self.pool[np.repeat(self.begin[index] - (stops - spread), spread) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, stops[text_units[1:] + np.arange(len(piece))]


@lru_cache(maxsize=2)
def encoder(tokenizer: str, end_id: int) -> Encoder:
    import public_tokenizers

    return Encoder(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer), end_id)


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, tokens_per_shard: int = TOKENS_PER_SHARD, by_id: bool = True) -> DataFrame:
    """Encodes (doc_id, text), writes the shards below ``folder`` (a URI that every executor
    reaches) and returns their manifest: file, part, seq, n_docs, n_tokens, in whose order
    (part, seq) the doc_ids ascend; without ``by_id`` the rows keep the order that docs has,
    unshuffled.  Evaluating it again writes files again: save it.

    A null or empty text is the end id alone; a null doc_id comes first; rows with the same
    doc_id stay apart, with ``by_id`` next to each other.  Other columns are ignored, whatever
    their names.  An empty table gives no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        code = encoder(tokenizer, end_id)
        store, root = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        names, held, doc_ids, ends, total, seq = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}-{attempt}.wm"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(encode(np.concatenate(held), doc_ids, np.array(ends), code.bits))
            names.append(name)
            return pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(ends)], "n_tokens": [total]})

        for batch in batches:
            for piece in slices(batch.column(1), ENCODE_BYTES):
                ids, stops = code.encode(piece)
                keys = batch.column(0).slice(piece.rows.start, len(piece)).to_pylist()
                at = 0
                while at < len(piece):  # cut at the text that fills the shard
                    began = int(stops[at - 1]) if at else 0
                    upto = min(len(piece), int(np.searchsorted(stops, began + tokens_per_shard - total, "left")) + 1)
                    held.append(ids[began : stops[upto - 1]])
                    doc_ids += keys[at:upto]
                    ends += (stops[at:upto] - began + total).tolist()
                    total = ends[-1]
                    at = upto
                    if total >= tokens_per_shard:
                        yield flush()
                        held, doc_ids, ends, total, seq = [], [], [], 0, seq + 1
        if ends:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if by_id:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return rows.mapInArrow(write, "file string, part int, seq int, n_docs long, n_tokens long")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``shard_start``, the ids before each shard: sums by part first, so
    that only one row a task meets in the ordering window."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(parts, "part").select("file", "part", "seq", "n_docs", "n_tokens", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers) and file."""
    spark = manifest.sparkSession
    starts = shard_starts(manifest).select("file", "shard_start")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder) if manifest.head(1) else spark.createDataFrame([], "path string, content binary")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = WaveletShard(batch.column(1)[i].as_py())
                ids = shard.decode().astype("<u4")
                ends = shard.doc_ends.tolist()
                begins = [0, *ends[:-1]]
                raw = memoryview(ids).cast("B")
                base = batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array([base + b for b in begins], pa.int64()),
                        pa.array([e - b for b, e in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([batch.column(0)[i].as_py()] * len(ends), pa.string()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                )

    # the narrow side meets the names only; a content is never shuffled
    joined = files.join(F.broadcast(starts), "file") if manifest.count() <= 100_000 else files.join(starts, "file")
    return joined.select("file", "content", "shard_start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_output(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID, tokens_per_shard: int = TOKENS_PER_SHARD, by_id: bool = True) -> DataFrame:
    """Writes the shards and reads them back (see write_shards, read_shards)."""
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = folder or f"{scratch.path}/shards"
    manifest = scratch.save(write_shards(docs, folder, tokenizer, end_id, tokens_per_shard, by_id), "manifest")
    return read_shards(manifest, folder)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return token_output(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
