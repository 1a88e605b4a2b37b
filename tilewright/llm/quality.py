"""Quality rules: exact text statistics, and the log-likelihood ratio of a trusted target against the raw corpus.

Word and word-pair hashes fall into ``BUCKETS`` buckets. Trusted documents (``labels.quality`` 1) and all documents each
give a multinomial over the buckets; a document's score is the mean, over its words and pairs, of the log ratio of the
two. It is kept when the score is at least ``THRESHOLD`` and no base rule fails.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tilewright.llm.common import HashedWords, per_batch, table, text_bytes

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 1.0
THRESHOLD = -0.1
WINDOW = 5
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
SMALL_LABELS = 2_000_000   # rows of labels (two numbers each) up to which they are broadcast

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT = np.uint32(32 - BUCKET_BITS)


def buckets_of(words: list[bytes], hashes: HashedWords) -> np.ndarray:
    """Buckets of all words, then of all neighbouring pairs."""
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))
    pairs = (ids[:-1] * _B) ^ (ids[1:] * _C)
    return np.concatenate([ids * _A, (pairs ^ (pairs >> np.uint32(15))) * _A]) >> _SHIFT


def with_flag(docs: DataFrame, labels: DataFrame, flag: str) -> DataFrame:
    """``docs`` with the label as ``_flag`` (null: none). Few labels are broadcast, many are joined by a shuffle."""
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(flag).cast("int")).alias("_flag"))
    if labels.count() <= SMALL_LABELS:
        marks = F.broadcast(marks)
    return docs.join(marks, docs["doc_id"] == F.col("_id"), "left").drop("_id")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio for each bucket, from all documents. ``2 * BUCKETS`` sums reach the driver, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = HashedWords(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data, flag in zip(text_bytes(batch), batch.column("_flag").to_pylist()):
                words = data.lower().split()
                if words:
                    seen = np.bincount(buckets_of(words, hashes), minlength=BUCKETS)
                    raw += seen
                    if flag == 1:
                        target += seen
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                                         names=["bucket", "raw", "target"])

    flagged = with_flag(docs.select("doc_id", "text"), labels, "quality").select("text", "_flag")
    rows = (flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that occur twice or more, first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, reach = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


def duplicate_lines(data: bytes) -> int:
    seen, found = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            found += 1
        elif line.strip():  # bytes.strip() takes the same white space as bytes.split()
            seen.add(line)
    return found


def measure(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The statistics, ``base_failed``, ``score`` and ``kept`` of every document.

    Null and empty texts have no words: every count is 0, the score is 0.0 and the base rule fails. Repeated rows and
    null identifiers stay as they are; other columns are left out. Without trusted documents every score is 0.0.
    """

    def work(batch: pa.RecordBatch) -> dict:
        hashes = HashedWords()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
        out: dict = {n: [] for n in names}
        for data in text_bytes(batch):
            words = data.split()
            n, repeats = len(words), repeated_words(words)
            failed = n < 10 or 100 * repeats > 20 * n
            score = float(ratios[buckets_of(data.lower().split(), hashes)].mean()) if n else 0.0
            row = (n, len(b"".join(words).decode("utf-8", "replace")), sum(map(data.count, SYMBOLS)),
                   duplicate_lines(data), repeats, failed, score, not failed and score >= threshold)
            for name, value in zip(names, row):
                out[name].append(value)
        return out

    whole, flag = T.LongType(), T.BooleanType()
    return per_batch(docs.select("doc_id", "text"), work, ["doc_id"], [
        ("n_words", whole), ("word_chars", whole), ("n_symbols", whole), ("n_dup_lines", whole),
        ("n_repeat_words", whole), ("base_failed", flag), ("score", T.DoubleType()), ("kept", flag)])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return measure(docs, log_ratios(docs, table(spark, sf_dir, "labels")))
