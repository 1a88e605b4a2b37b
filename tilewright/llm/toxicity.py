"""Toxicity: linear classifier on hashed byte n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct buckets of its lower-cased byte n-grams. Labelled documents give smoothed log-count
ratios r of toxic against other texts, and those that are not significant become 0; a logistic regression on the
features scaled by r is fitted with weight decay, so a bucket's share of the score is r times its weight. Scores are
probabilities; class weights restore the labelled share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tilewright.llm.common import fold, keep, per_batch, table, text_bytes

BITS = 18
ORDERS = (3, 4, 5, 6)
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE_PER_CLASS = 1500        # bound of the labelled sample that the classifier is fitted on (expected rows)
SAMPLE_ENTRIES = 12_000_000    # and of its features in all: a text beyond it is not taken into the sample
SMOOTHING, DECAY, STEPS, RATE = 1.0, 1e-3, 100, 0.05
LEAST_SIGNIFICANCE = 3.0       # standard errors that a log-count ratio must be away from 0 to count

_SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
_FACTORS = {3: np.uint32(0x9E3779B1), 4: np.uint32(0x85EBCA6B), 5: np.uint32(0xC2B2AE35), 6: np.uint32(0x27D4EB2F)}


class Features:
    """Distinct buckets of a text; the array of marks is reused from text to text."""

    def __init__(self, bits: int = BITS):
        self.shift, self.marks = np.uint32(32 - bits), np.zeros(1 << bits, bool)

    def __call__(self, data: bytes) -> np.ndarray:
        a = np.frombuffer(b" " + data.lower().translate(_SPACES) + b" ", np.uint8).astype(np.uint32)
        if len(a) < max(ORDERS):
            a = np.concatenate([a, np.full(max(ORDERS) - len(a), 32, np.uint32)])
        gram = a[:-1] | (a[1:] << np.uint32(8))
        for n in range(3, max(ORDERS) + 1):
            if n < 5:
                gram = gram[:-1] | (a[n - 1:] << np.uint32(8 * (n - 1)))
            else:
                gram = gram[:-1] * np.uint32(31) + a[n - 1:]
            if n in ORDERS:
                mixed = gram * _FACTORS[n]
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x2C1B3C6D)
                self.marks[mixed >> self.shift] = True
        found = np.flatnonzero(self.marks)
        self.marks[found] = False
        return found


def fit(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(share of the score of each bucket, intercept) by full-batch Adam on the weighted logistic loss."""
    size = 1 << bits
    index, lengths = np.concatenate(rows).astype(np.int32), np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    counts = np.stack([np.bincount(index, weights=(toxic == k)[owner], minlength=size) for k in (0, 1)]) + SMOOTHING
    texts = np.array([(toxic == k).sum() for k in (0, 1)]) + 2 * SMOOTHING
    ratio = np.log(counts[1] / texts[1]) - np.log(counts[0] / texts[0])
    ratio[np.abs(ratio) < LEAST_SIGNIFICANCE * np.sqrt((1 / counts).sum(axis=0))] = 0.0
    values = ratio.astype(np.float32)[index]
    weights, bias = np.zeros(size), float(np.log((weight * toxic).sum() / (weight * (1 - toxic)).sum()))
    first, second, moments = np.zeros(size), np.zeros(size), [0.0, 0.0]
    weight = weight / weight.sum()
    for step in range(1, STEPS + 1):
        margin = np.add.reduceat(values * weights[index], starts) + bias
        error = weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - toxic)
        slope = np.bincount(index, weights=error[owner] * values, minlength=size) + DECAY * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        moments = [0.9 * moments[0] + 0.1 * error.sum(), 0.999 * moments[1] + 0.001 * error.sum() ** 2]
        grow = RATE * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
        weights -= grow * first / (np.sqrt(second) + 1e-8)
        bias -= grow * moments[0] / (moments[1] ** 0.5 + 1e-8)
    return (ratio * weights).astype(np.float32), bias


def sample_keys(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(_id, _toxic, of the sample; labelled rows by class), from the labels of the training folds.

    A document with several labels counts as toxic if any says so. Rows are drawn by the hash of their identifier, each
    class with the same expected number, so the sample is bounded and the same in every run.
    """
    marks = (labels.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic")))
    sizes = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    part = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000))
    chosen = F.lit(False)
    for toxic in (0, 1):
        share = min(1.0, SAMPLE_PER_CLASS / max(1, sizes.get(toxic, 0)))
        chosen = chosen | ((F.col("_toxic") == toxic) & (part < int(share * 1_000_000)))
    return marks.where(chosen), sizes


def sample_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(_id, _toxic, text): one row for each sampled label that has a document.

    A label counts once, however many rows and texts its identifier has: the text with the smallest hash stands for it.
    So the sample is bounded in rows, and a frequent identifier pushes no other label out.
    """
    labelled = docs.join(F.broadcast(keys), docs["doc_id"] == F.col("_id")).withColumn("_h", F.xxhash64("text"))
    least = labelled.groupBy("_id", "_toxic").agg(F.min("_h").alias("_least"))
    texts = docs.withColumn("_h", F.xxhash64("text")).join(
        F.broadcast(least), (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_least")))
    return texts.groupBy("_id", "_toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Classifier from the labelled documents outside the held-out fold.

    One task fits it, on at most ``SAMPLE_ENTRIES`` features. Without labels of both classes no feature counts and every
    score is the share of toxic labels (0.5 without any).
    """
    keys, sizes = sample_keys(labels)
    flat = np.zeros(1 << BITS, np.float32)
    if not (sizes.get(0) and sizes.get(1)):
        share = 0.5 if not sizes else float(bool(sizes.get(1)))
        return flat, 20.0 * (2 * share - 1)

    def features(batch: pa.RecordBatch) -> dict:
        distinct = Features()
        return {"buckets": [distinct(data) for data in text_bytes(batch)]}

    rows = keep(per_batch(sample_texts(docs, keys), features, ["_id", "_toxic"], [("buckets", T.ArrayType(T.IntegerType()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, toxic, entries = [], [], 0
        for batch in batches:
            for row, label in zip(batch.column("buckets"), batch.column("_toxic").to_pylist()):
                entries += len(row.values)
                if entries > SAMPLE_ENTRIES:
                    entries -= len(row.values)
                    continue
                found.append(np.asarray(row.values, np.int32))
                toxic.append(label)
        if len(set(toxic)) == 2:
            y = np.array(toxic, np.float64)
            weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
            shares, bias = fit(found, y, weight)
            yield pa.RecordBatch.from_pydict({"shares": [shares.tobytes()], "bias": [bias]})

    order = F.xxhash64("_id", F.lit("order"))
    fitted = rows.repartition(1).sortWithinPartitions(order, "_id").mapInArrow(run, "shares binary, bias double").head()
    if fitted is None:  # the labelled documents are not all there
        return flat, float(np.log(sizes[1] / sizes[0]))
    return np.frombuffer(fitted["shares"], np.float32), fitted["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], columns: list[str], score: str = "score") -> DataFrame:
    """``columns`` of every document and its score; null text is scored as an empty one."""
    shares, bias = model

    def work(batch: pa.RecordBatch) -> dict:
        distinct = Features()
        margins = np.array([shares[distinct(data)].sum(dtype=np.float64) for data in text_bytes(batch)]) + bias
        return {score: 1.0 / (1.0 + np.exp(-np.clip(margins, -30, 30)))}

    return per_batch(docs, work, columns, [(score, T.DoubleType())])


def op2(spark, sf_dir: str) -> DataFrame:
    """Score of every document. Repeated rows and null identifiers (never held out) are scored like any other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not predicted toxic, with their columns."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return scored(docs, model, docs.columns, name).where(F.col(name) < THRESHOLD).drop(name)
