"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of ``PASSAGE`` words. A randomised SVD of their TF-IDF matrix (words hashed to
``BUCKETS`` columns, document frequencies from the whole corpus) gives a latent space. Every document is read in windows
of the same length; windows that take enough of their TF-IDF weight from benchmark words are projected, and those whose
cosine with a passage is high are candidates. A candidate counts when the longest common subsequence of the item and the
text around it is long, or, for paraphrases, when it is fairly long and the answer is there too, or, for excerpts of a
longer item, when a retrieved passage is there nearly whole.

The space is fitted on all benchmark passages; every document is searched whole. Large benchmarks are taken in blocks of
``ITEMS_PER_BLOCK`` items, each of which is a search of its own, so what tasks hold is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tilewright.llm.common import keep, per_batch, table, text_bytes

PASSAGE, STRIDE = 20, 10
BUCKETS = 1 << 18
RANK, OVERSAMPLE, POWER_ROUNDS = 128, 8, 2
LEAST_WEIGHT = 0.35        # share of a window's squared TF-IDF weight in words of the benchmark
LEAST_COSINE = 0.5
LEAST_COMMON = 0.7         # of the item's words, in order
LEAST_PARAPHRASE = 0.5     # the same, when the answer is found
LEAST_EXCERPT = 0.9        # of the words of a retrieved passage, in order, whatever the item's length
LEAST_ANSWER = 0.8         # of the answer's words, in order
ANSWER_WORDS = 6           # an item without an answer of its own: its last words
ITEMS_PER_BLOCK = 10_000
BLOCK_BYTES = 1 << 20
_EDGE = b".,;:!?\"'()[]{}"


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SOLID = np.ones(256, bool)  # bytes that neither part words nor fall off at their ends
_SOLID[list(b" \t\n\v\f\r" + _EDGE)] = False
_FACTOR = 0x9E3779B97F4A7C15
_POWERS, _INVERSES = (np.concatenate([[np.uint64(1)], np.full(BLOCK_BYTES, x, np.uint64)]).cumprod(dtype=np.uint64)
                      for x in (_FACTOR, pow(_FACTOR, -1, 2 ** 64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_POWERS):
        return _POWERS[:n], _INVERSES[:n]
    return tuple(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]).cumprod(dtype=np.uint64)
                 for x in (_FACTOR, pow(_FACTOR, -1, 2 ** 64)))


def _block_ids(data: bytes) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of the words of lower-case bytes, by differences of prefix sums."""
    codes = np.frombuffer(data, np.uint8)
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begins, ends = edges[::2], edges[1::2]
    solid = np.flatnonzero(_SOLID[codes])
    if not len(solid):
        return np.zeros(len(begins), np.int64)
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(_SOLID[codes], out=before[1:])
    first, last = before[begins], before[ends]
    some = last > first  # others are nothing but edge characters
    begins = np.where(some, solid[np.minimum(first, len(solid) - 1)], 0)
    ends = np.where(some, solid[last - 1] + 1, 0)
    powers, inverses = _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    value = (sums[ends] - sums[begins]) * inverses[begins]
    return ((value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(1)).astype(np.int64)


def word_ids(data: bytes) -> np.ndarray:
    """A hash for each word of the text, without the punctuation at its ends; equal words have equal hashes.

    Long texts are taken in blocks of ``BLOCK_BYTES``, cut between words.
    """
    lower = data.lower() if data.isascii() else data.decode("utf-8", "replace").lower().encode()
    if len(lower) <= BLOCK_BYTES:
        return _block_ids(lower)
    parts, at = [], 0
    while at < len(lower):
        gap = _SPACE.search(lower, at + BLOCK_BYTES - 1)
        end = gap.end() if gap else len(lower)
        parts.append(_block_ids(lower[at:end]))
        at = end
    return np.concatenate(parts)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with a word of the bucket, documents), of all documents; ``BUCKETS`` sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for data in text_bytes(batch):
                counts[np.unique(word_ids(data) & (BUCKETS - 1))] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], rows))],
                                         names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = found.toArrow()  # rows would be objects of Python, a hundred megabytes of the driver's memory
    bucket, n = (got.column(c).to_numpy() for c in ("bucket", "n"))
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def passages_of(ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(offset, words) of the passages; the last one ends with the item."""
    starts = list(range(0, max(1, len(ids) - PASSAGE + 1), STRIDE))
    if len(ids) > PASSAGE and starts[-1] + PASSAGE < len(ids):
        starts.append(len(ids) - PASSAGE)
    return [(s, ids[s:s + PASSAGE]) for s in starts]


def latent_space(items: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their rows in the space), by randomised range finding on the TF-IDF passages of ``items``.

    A product with the matrix and its transpose is one Spark job: tasks multiply their own passages and Spark adds the
    parts by bucket. The driver orthonormalises ``RANK + OVERSAMPLE`` columns over the benchmark's buckets.
    """
    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for data in text_bytes(batch):
            for _, words in passages_of(word_ids(data)):
                if len(words):
                    buckets, often = np.unique(words & (BUCKETS - 1), return_counts=True)
                    weight = often * idf[buckets]
                    yield buckets, weight / max(np.linalg.norm(weight), 1e-12)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            for buckets, _ in rows_of(batch):
                seen[buckets] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["bucket"])

    buckets = np.sort(items.mapInArrow(used, "bucket long").distinct().toArrow().column("bucket").to_numpy())
    rank = min(RANK + OVERSAMPLE, len(buckets))
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))

    def product(basis: np.ndarray) -> np.ndarray:
        shared = items.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(shared.value)
            for batch in batches:
                for b, weight in rows_of(batch):
                    rows = place[b]
                    out[rows] += weight[:, None] * (weight @ shared.value[rows])
            some = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(out[some, j]) for j in range(rank))],
                                             names=["row", *(f"z{j}" for j in range(rank))])

        schema = ", ".join(["row long", *(f"z{j} double" for j in range(rank))])
        total = items.mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"z{j}").alias(f"z{j}") for j in range(rank)))
        got, out = total.toArrow(), np.zeros_like(basis)
        out[got.column("row").to_numpy()] = np.stack([got.column(f"z{j}").to_numpy() for j in range(rank)], axis=1)
        shared.destroy()
        return out

    if not len(buckets):
        return buckets, np.zeros((0, 0))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((len(buckets), rank)))[0]
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    return buckets, basis @ turn[:, np.argsort(values)[::-1][:RANK]]


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each word of the item."""
    full = state = (1 << length) - 1
    for word in words:
        match = state & masks.get(word, 0)
        state = ((state + match) | (state - match)) & full
    return length - state.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | (1 << i)
    return out


class Index:
    """What a task needs to search a text for one block of items."""

    def __init__(self, items: list[tuple], idf: np.ndarray, buckets: np.ndarray, space: np.ndarray):
        self.items, owners, offsets, rows = [], [], [], []
        self.idf, self.space = idf, space
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        for item, text, answer in items:
            words = word_ids((text or "").encode())
            asked = word_ids((answer or "").encode()) if answer else words[-ANSWER_WORDS:]
            if not len(words):
                continue
            for offset, part in passages_of(words):
                owners.append(len(self.items))
                offsets.append(offset)
                rows.append(self.project(part[None, :] & (BUCKETS - 1))[0])
            self.items.append((item, words.tolist(), _masks(words.tolist()), asked.tolist()))
        self.owners, self.offsets = np.array(owners), np.array(offsets)
        self.latent = _unit(np.array(rows)).astype(np.float32) if rows else np.zeros((0, 0), np.float32)

    def project(self, windows: np.ndarray) -> np.ndarray:
        """Latent vectors of windows of buckets (-1: no word)."""
        row = np.where(windows >= 0, self.place[windows], -1)
        weight = np.where(row >= 0, self.idf[windows], 0.0)
        return np.einsum("nw,nwk->nk", weight, self.space[row])

    def compare(self, k: int, words: np.ndarray, begin: int, offsets: list[int]) -> tuple[int, bool] | None:
        """(common words, answer found) of item ``k`` and the text where it would begin, if that is a leak.

        ``offsets`` are those of the item's passages that were retrieved there.
        """
        _, item, masks, asked = self.items[k]
        slack = PASSAGE + len(item) // 4
        near = words[max(0, begin - slack):max(0, begin + len(item) + slack)].tolist()
        present = set(near)
        # no common subsequence is longer than the number of words present
        few = sum(map(present.__contains__, item)) < LEAST_PARAPHRASE * len(item)
        common = 0 if few else common_subsequence(masks, len(item), near)
        if few or common < LEAST_COMMON * len(item):
            excerpt = any(self.holds_passage(item, words, begin, offset) for offset in offsets)
            if not excerpt and (few or common < LEAST_PARAPHRASE * len(item)):
                return None
        else:
            excerpt = True
        answer = common_subsequence(_masks(asked), len(asked), near) >= LEAST_ANSWER * len(asked)
        if not excerpt and not answer:
            return None
        return common_subsequence(masks, len(item), near) if few else common, answer

    @staticmethod
    def holds_passage(item: list[int], words: np.ndarray, begin: int, offset: int) -> bool:
        """Whether the passage is nearly whole, and in order, in the text around the window that retrieved it."""
        passage, at = item[offset:offset + PASSAGE], begin + offset
        near = words[max(0, at - STRIDE):at + PASSAGE + STRIDE].tolist()
        least = LEAST_EXCERPT * len(passage)
        if sum(map(set(near).__contains__, passage)) < least:
            return False
        return common_subsequence(_masks(passage), len(passage), near) >= least

    def hits(self, words: np.ndarray) -> Iterator[tuple]:
        """(item, cosine, common words, share of the item, answer found): the best for each item."""
        if not len(words) or not len(self.latent):
            return
        bucket = words & (BUCKETS - 1)
        square = self.idf[bucket] ** 2
        inside = np.where(self.place[bucket] >= 0, square, 0.0)
        n = len(words)
        starts = np.arange(0, max(1, n - STRIDE), STRIDE)
        ends = np.minimum(starts + PASSAGE, n)
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (inside, square)]
        part, whole = (s[ends] - s[starts] for s in sums)
        starts = starts[(part >= LEAST_WEIGHT * whole) & (part > 0)]
        best: dict[int, tuple] = {}
        for lo in range(0, len(starts), 2048):
            some = starts[lo:lo + 2048]
            at = some[:, None] + np.arange(PASSAGE)
            latent = _unit(self.project(np.where(at < n, bucket[np.minimum(at, n - 1)], -1))).astype(np.float32)
            for first in range(0, len(self.latent), 8192):
                cosine = latent @ self.latent[first:first + 8192].T
                window, passage = np.nonzero(cosine >= LEAST_COSINE)
                near = {}  # windows and passages that place the item alike count once, with their best cosine
                offsets = self.offsets[first + passage]
                for k, begin, value, offset in zip(self.owners[first + passage].tolist(), (some[window] - offsets).tolist(),
                                                   cosine[window, passage].tolist(), offsets.tolist()):
                    held = near.setdefault((k, begin), [0.0, []])
                    held[0] = max(value, held[0])
                    held[1].append(offset)
                for (k, begin), (value, there) in near.items():
                    found = self.compare(k, words, begin, there)
                    if found:
                        found = (found[0], value, found[1])
                        best[k] = max(best.get(k, found), found)
        for k, (common, cosine, answer) in best.items():
            yield self.items[k][0], cosine, common, common / len(self.items[k][1]), answer


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast :class:`Index` for each block of items. ``benchmark`` has item_id, text and perhaps answer."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = keep(benchmark.select("item_id", "text", answer.alias("answer")))
    count = items.count()
    if not count:
        return
    frequency, total = document_frequencies(docs)
    idf = np.log((total + 1) / (frequency + 1))
    blocks = -(-count // ITEMS_PER_BLOCK)
    for block in range(blocks):
        some = keep(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)) if blocks > 1 else items
        rows = [(r["item_id"], r["text"], r["answer"]) for r in some.orderBy("item_id").collect()]  # of one block
        yield docs.sparkSession.sparkContext.broadcast(Index(rows, idf, *latent_space(some, idf)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common_words, common_share, answer_found): the documents that hold an item.

    Null and empty texts, on either side, hold and match nothing. Repeated rows give their pairs each; other columns are
    left out. Without items or documents there are no rows.
    """
    hit = T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("cosine", T.DoubleType()),
                        T.StructField("common_words", T.LongType()), T.StructField("common_share", T.DoubleType()),
                        T.StructField("answer_found", T.BooleanType())])
    out = None
    for shared in indexes(docs, benchmark):
        def work(batch: pa.RecordBatch, shared=shared) -> dict:
            names = hit.names
            return {"hits": [[dict(zip(names, h)) for h in shared.value.hits(word_ids(data))]
                             for data in text_bytes(batch)]}

        found = per_batch(docs.select("doc_id", "text"), work, ["doc_id"], [("hits", T.ArrayType(hit))])
        found = found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], T.StructType([docs.schema["doc_id"], *hit.fields]))
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item, with their columns."""
    clean = docs
    for shared in indexes(docs, table(spark, sf_dir, "benchmark")):
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [next(shared.value.hits(word_ids(data)), None) is None for data in text_bytes(batch)]
                yield batch.filter(pa.array(good, pa.bool_()))

        clean = clean.mapInArrow(run, docs.schema)
    return clean
