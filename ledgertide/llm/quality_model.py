"""Operator 1, quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Units are runs of letters, digits and non-ASCII bytes, and runs of other signs, in their
own case; a unit that repeats the one before it becomes one fixed token.  Uni- and bigrams are hashed into ``BUCKETS`` weights.  The model is
fitted on a bounded sample (``max_train`` labelled rows, those with the smallest hash of
doc_id, whatever the corpus's size).  A third of the sample calibrates: its margins under
a model of the other two thirds give the slope and offset (Platt) that make a score a
probability, also where most labels are of one class.  Every document is scored in one
pass without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import Slice, byte_class, ngram_hashes, prefix_hashes, slices, span_hashes
from ledgertide.llm.shared import table

BUCKETS = 1 << 20
MAX_TRAIN = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
#: The value of the feature that every text has.
BIAS = 0.3
LETTERS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SIGNS = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Stands for a unit that is the same as the one before.
AGAIN = np.uint64(0x5851F42D4C957F2D)
_KIND = (LETTERS * 1 + SIGNS * 2).astype(np.uint8)


def features(piece: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their values (log counts, of unit length)."""
    kind = _KIND[piece.data]
    n = len(kind)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[piece.offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    some = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[some], ends[some]
    units = span_hashes(prefix_hashes(piece.data), starts, ends)
    first = np.searchsorted(starts, piece.offsets)
    again = np.flatnonzero(units[1:] == units[:-1]) + 1
    units[np.setdiff1d(again, first)] = AGAIN
    pairs = ngram_hashes(units, 2)
    one, two = (units % np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)
    for i in range(len(piece)):
        a, b = first[i], first[i + 1]
        own = np.sort(np.concatenate([one[a:b], two[a : max(a, b - 1)]]))
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        values = 1 + np.log(np.diff(np.append(new, len(own)))) if len(own) else np.zeros(0)
        yield own[new], values / max(1e-9, np.sqrt((values * values).sum()))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal updates in the order given."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    bias = np.array([BUCKETS])

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for index, values, label in examples:
            at, x = np.concatenate([index, bias]), np.append(values, BIAS)
            w = weights(at)
            g = (sigmoid(float(w @ x)) - label) * x
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    return weights(np.arange(BUCKETS + 1))


def platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (Newton steps, with Platt's
    smoothed targets); 1 and 0 where one class is missing."""
    good, bad = int(labels.sum()), int((1 - labels).sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones(len(margins))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(w @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def calibrated(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights from all examples, scaled by the slope and offset that every third one gives
    under a model of the rest."""
    rest, third = [x for i, x in enumerate(examples) if i % 3], examples[::3]
    trial = train(rest)
    margins = np.array([float(trial[index] @ values) + BIAS * trial[BUCKETS] for index, values, _ in third])
    slope, offset = platt(margins, np.array([label for _, _, label in third]))
    weights = slope * train(examples)
    weights[BUCKETS] += offset / BIAS
    return weights


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """The model's weights (float32), from labelled rows that aren't held out.

    Rows without a label or doc_id are skipped; doc_id may be of any type.  Of labels that say
    the same of a doc_id, and of documents that share one, one counts (the text with the
    smallest hash), so that no repetition makes the sample grow.  Without any label all
    weights are 0.  Other columns are ignored, whatever their names.
    """
    chosen = labels.select(F.col("doc_id").alias("labelled"), "quality").where(F.col("quality").isNotNull() & F.col("labelled").isNotNull() & ~held_out(F.col("labelled"))).distinct()
    chosen = chosen.withColumn("turn", F.xxhash64(F.col("labelled").cast("string"))).orderBy("turn", "labelled", "quality").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = rows.groupBy("turn", "labelled", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("turn", "text", "quality")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                both = list(features(piece))
                part = batch.slice(piece.rows.start, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2).cast(pa.int32()), pa.array([x.astype(np.int32).tobytes() for x, _ in both], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in both], pa.binary())],
                    ["turn", "quality", "buckets", "values"],
                )

    def learn(group: pa.Table) -> pa.Table:
        turn, quality, index, values = (group[c].to_pylist() for c in ("turn", "quality", "buckets", "values"))
        order = sorted(range(len(turn)), key=lambda i: (turn[i], quality[i], index[i]))  # the same wherever it runs
        examples = [(np.frombuffer(index[i], np.int32).astype(np.int64), np.frombuffer(values[i], np.float32).astype(float), int(quality[i] > 0)) for i in order]
        return pa.table({"weights": pa.array([calibrated(examples).astype(np.float32).tobytes()], pa.binary())})

    # at most max_train rows meet in this group
    model = rows.mapInArrow(featurise, "turn long, quality int, buckets binary, values binary").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "weights binary").collect()
    return np.frombuffer(model[0].weights, np.float32) if model else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, text) -> doc_id, score (0 to 1), a row for each row; a null or empty text gets
    the bias's score.  Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for piece in slices(batch.column(1)):
                sums = np.array([float(w[index] @ values) for index, values in features(piece)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.rows.start, len(piece)), pa.array(sigmoid(sums + BIAS * float(w[BUCKETS])), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
