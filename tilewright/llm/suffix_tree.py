"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of the normalised text: lower-cased words with a space between, and an end mark. That string and
the sequence of tokens (words, then one end) determine each other, so its probability is that of the tokens.

A context of up to ``DEPTH`` symbols becomes a node when it is frequent enough and its next-symbol distribution diverges
from that of the context one symbol shorter: twice the log-likelihood ratio must reach ``LEAST_DIVERGENCE``. Frequent
means ``LEAST_COUNT`` occurrences, however large the corpus, so the tree grows with it; only contexts of up to ``HEAD``
symbols must have ``LEAST_SHARE`` of all symbols instead. Suffixes of nodes of the same kind are nodes too. A node's
distribution is smoothed towards that of the longest node among its suffixes (Witten and Bell), the root's towards
uniform, and each symbol is scored in the node of the longest suffix that has one.

Counts come from all training documents. The head is bounded by its share (``1 / LEAST_SHARE`` contexts of each length)
and broadcast. Deeper nodes never meet in one place: texts are taken in blocks, each block sends its distinct grams to
buckets by the last ``HEAD`` symbols of the context, a bucket adds them up, grows the part of the tree behind those
symbols and sends every block the log probabilities of its grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tilewright.llm.common import fold, keep, table, text_bytes

DEPTH, HEAD = 6, 4
LEAST_COUNT = 8
LEAST_SHARE = 4e-6
LEAST_DIVERGENCE = 20.0
END = 10
FOLDS, HELD_OUT = 7, 2
PIECE_BYTES = 1 << 20     # text whose grams are at hand at once; arrays are 8 times as large
VOCABULARY = 600_000      # distinct words from which a block is closed
BLOCK_GRAMS = 3_000_000   # distinct grams from which a block is closed
FRESH_GRAMS = 1_000_000   # grams of pieces that wait to be merged
BUCKET_BYTES = 4 << 20    # text for each bucket of grams


def grams_of(joined: bytes) -> np.ndarray:
    """Context and symbol at every position from ``DEPTH`` on, as one number."""
    a = np.frombuffer(joined, np.uint8).astype(np.int64)
    gram = a[:len(a) - DEPTH].copy()
    for i in range(1, DEPTH + 1):
        gram <<= 8
        gram |= a[i:len(a) - DEPTH + i]
    return gram


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every symbol, start of each text). A text begins after end marks and ends with one."""
    pad = bytes([END]) * DEPTH
    gram = grams_of(pad + pad.join(texts) + bytes([END]))
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths[:-1] + DEPTH - 1)])
    counted = np.ones(len(gram), bool)
    for i in range(1, DEPTH):  # of the end marks between two texts only the first is a symbol
        counted[begins[1:] - i] = False
    return gram[counted], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def gram_pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grams, start of each text, its number) in pieces of about ``PIECE_BYTES``; a longer text is cut into several."""
    held, numbers, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) > PIECE_BYTES:
            whole = bytes([END]) * DEPTH + text + bytes([END])
            for lo in range(0, len(text) + 1, PIECE_BYTES):
                yield grams_of(whole[lo:lo + PIECE_BYTES + DEPTH]), np.zeros(1, np.int64), np.array([i])
            continue
        held.append(text)
        numbers.append(i)
        size += len(text)
        if size >= PIECE_BYTES:
            yield *windows(held), np.array(numbers)
            held, numbers, size = [], [], 0
    if held:
        yield *windows(held), np.array(numbers)


def merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    keys, counts = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


class GramCounts:
    """Distinct grams of a block with their counts in training texts; grams of other texts count 0."""

    def __init__(self):
        self.done = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], training: bool) -> None:
        for grams, _, _ in gram_pieces(texts):
            keys, counts = np.unique(grams, return_counts=True)
            self.fresh.append((keys, counts if training else np.zeros(len(keys), np.int64)))
            if sum(len(k) for k, _ in self.fresh) > FRESH_GRAMS:
                self.merge()

    def merge(self) -> None:
        if self.fresh:
            self.done = merged([self.done, *self.fresh])
            self.fresh = []


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the last ``HEAD`` symbols of the context."""
    tail = (grams.astype(np.uint64) >> np.uint64(8)) & np.uint64((1 << (8 * HEAD)) - 1)
    return ((tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


class Tree:
    """Nodes by depth as sorted arrays: contexts, and (node, symbol) with its probability."""

    def __init__(self, depth: int = DEPTH):
        self.contexts = [np.zeros(0, np.int64) for _ in range(depth + 1)]
        self.spare = [np.zeros(0) for _ in range(depth + 1)]     # weight of the parent's distribution
        self.keys = [np.zeros(0, np.int64) for _ in range(depth + 1)]
        self.chances = [np.zeros(0) for _ in range(depth + 1)]

    def probability(self, grams: np.ndarray, depth: np.ndarray | int | None = None) -> np.ndarray:
        """Probability of the last symbol of each gram in its longest node (of at most ``depth``)."""
        symbol, context = grams & 255, grams >> 8
        left, factor = np.ones(len(grams), bool), np.ones(len(grams))
        out = np.zeros(len(grams))
        top = len(self.contexts) - 1
        for d in range(top if depth is None else depth, -1, -1):
            if not len(self.contexts[d]):
                continue
            rows = np.flatnonzero(left)
            at = context[rows] & ((1 << (8 * d)) - 1)
            place = np.minimum(np.searchsorted(self.contexts[d], at), len(self.contexts[d]) - 1)
            hit = self.contexts[d][place] == at
            rows, at, place = rows[hit], at[hit], place[hit]
            key = (at << 8) | symbol[rows]
            found = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
            seen = self.keys[d][found] == key
            out[rows[seen]] = factor[rows[seen]] * self.chances[d][found[seen]]
            left[rows[seen]] = False
            factor[rows[~seen]] *= self.spare[d][place[~seen]]
        out[left] = factor[left] / 256.0
        return out

    def add_level(self, depth: int, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> None:
        """Nodes of one depth from rows (context, symbol, count); shallower levels must be there."""
        order = np.lexsort((symbols, contexts))
        contexts, symbols, counts = contexts[order], symbols[order], counts[order].astype(np.float64)
        nodes, first, kinds = np.unique(contexts, return_index=True, return_counts=True)
        if not len(nodes):
            return
        totals = np.add.reduceat(counts, first)
        parent = self.probability((contexts << 8) | symbols, depth - 1) if depth else np.full(len(counts), 1 / 256.0)
        owner = np.repeat(np.arange(len(nodes)), kinds)
        self.contexts[depth], self.spare[depth] = nodes, kinds / (totals + kinds)
        self.keys[depth] = (contexts << 8) | symbols
        self.chances[depth] = (counts + kinds[owner] * parent) / (totals + kinds)[owner]


def grow(counts: DataFrame) -> Tree:
    """The head of the tree from (gram, c) with contexts of ``HEAD`` symbols, each tested against the next shorter one.

    Only nodes reach the driver: at most ``1 / LEAST_SHARE`` contexts for each depth, with the symbols seen after them.
    """
    levels = {HEAD: counts.select((F.shiftright("gram", 8)).alias("context"),
                                  F.col("gram").bitwiseAND(255).alias("symbol"), "c")}
    total = counts.agg(F.sum("c")).head()[0] or 0
    tested = {}
    for d in range(HEAD, -1, -1):
        rows = levels[d]
        sums = rows.groupBy("context").agg(F.sum("c").alias("n")).where(F.col("n") >= F.lit(LEAST_SHARE * total))
        levels[d] = keep(rows.join(sums, "context"))  # frequent contexts only: their suffixes are as frequent
        if d:
            mask = F.lit((1 << (8 * (d - 1))) - 1).cast("long")
            levels[d - 1] = keep(rows.groupBy(F.col("context").bitwiseAND(mask).alias("context"), "symbol")
                                 .agg(F.sum("c").alias("c")))
    for d in range(1, HEAD + 1):
        mask = F.lit((1 << (8 * (d - 1))) - 1).cast("long")
        parent = levels[d - 1].select(F.col("context").alias("p"), "symbol", (F.col("c") / F.col("n")).alias("q"))
        both = levels[d].withColumn("p", F.col("context").bitwiseAND(mask)).join(parent, ["p", "symbol"])
        gain = 2 * F.sum(F.col("c") * F.log(F.col("c") / F.col("n") / F.col("q")))
        tested[d] = both.groupBy("context").agg(gain.alias("gain")).where(F.col("gain") >= LEAST_DIVERGENCE).select("context")
    nodes = None
    picked = {}
    for d in range(HEAD, 0, -1):  # suffixes of nodes are nodes
        mask = F.lit((1 << (8 * d)) - 1).cast("long")
        longer = nodes.select(F.col("context").bitwiseAND(mask).alias("context")) if nodes is not None else None
        nodes = keep((tested[d] if longer is None else tested[d].unionByName(longer)).distinct())
        picked[d] = nodes
    tree = Tree(HEAD)
    for d in range(HEAD + 1):
        level = levels[d].join(picked[d], "context", "left_semi") if d else levels[0]
        got = level.select("context", "symbol", "c").toArrow()
        tree.add_level(d, *(got.column(k).to_numpy() for k in ("context", "symbol", "c")))
    return tree


def branch(head: Tree, grams: np.ndarray, counts: np.ndarray) -> Tree:
    """``head`` with the deeper nodes behind the contexts of ``HEAD`` symbols whose grams are all given, each once."""
    tree = Tree(DEPTH)
    for name in ("contexts", "spare", "keys", "chances"):
        getattr(tree, name)[:HEAD + 1] = getattr(head, name)
    seen = counts > 0
    levels = {DEPTH: (grams[seen], counts[seen])}
    for d in range(DEPTH - 1, HEAD - 1, -1):
        keys, c = levels[d + 1]
        levels[d] = merged([(keys & ((1 << (8 * (d + 1))) - 1), c)])
    picked, shares = {}, None
    for d in range(HEAD, DEPTH + 1):
        keys, c = levels[d]
        contexts, owner = np.unique(keys >> 8, return_inverse=True)
        n = np.bincount(owner, weights=c, minlength=len(contexts))
        if d > HEAD:
            shorter, q = shares
            ratio = np.log(c / n[owner] / q[np.searchsorted(shorter, keys & ((1 << (8 * d)) - 1))])
            gain = 2 * np.bincount(owner, weights=c * ratio, minlength=len(contexts))
            picked[d] = contexts[(n >= LEAST_COUNT) & (gain >= LEAST_DIVERGENCE)]
        shares = keys, c / n[owner]
    for d in range(DEPTH - 1, HEAD, -1):  # suffixes of nodes are nodes
        picked[d] = np.union1d(picked[d], picked[d + 1] & ((1 << (8 * d)) - 1))
    for d in range(HEAD + 1, DEPTH + 1):
        keys, c = levels[d]
        node = np.isin(keys >> 8, picked[d])
        tree.add_level(d, keys[node] >> 8, keys[node] & 255, c[node])
    return tree


def log10_scores(keys: np.ndarray, logs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each normalised text, from that of every gram (``keys`` in order)."""
    out = np.zeros(len(texts))
    for grams, starts, numbers in gram_pieces(texts):
        distinct, inverse = np.unique(grams, return_inverse=True)
        out[numbers] += np.add.reduceat(logs[np.searchsorted(keys, distinct)][inverse], starts)
    return out


def _padded(columns: dict, rows: int, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def blocks_of(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of four kinds for each block (part, seq) of documents, told apart by the column that is not null.

    ``body``: a document in its place (``pos``) with its normalised text, packed. ``local``: a word of the block and how
    often training texts have it. ``bucket``: the block's distinct grams of one bucket with their counts. ``gram``: counts
    of contexts of ``HEAD`` symbols. A block ends at ``VOCABULARY`` words or ``BLOCK_GRAMS`` grams.
    """
    fields = [("part", T.LongType()), ("seq", T.IntegerType()), ("pos", T.LongType()),
              ("doc_id", docs.schema["doc_id"].dataType), ("held_out", T.BooleanType()), ("body", T.BinaryType()),
              ("local", T.IntegerType()), ("word", T.BinaryType()), ("c", T.LongType()), ("gram", T.LongType()),
              ("bucket", T.LongType()), ("keys", T.BinaryType()), ("counts", T.BinaryType())]
    kinds = {"part": pa.int64(), "seq": pa.int32(), "pos": pa.int64(), "held_out": pa.bool_(), "body": pa.binary(),
             "local": pa.int32(), "word": pa.binary(), "c": pa.int64(), "gram": pa.int64(), "bucket": pa.int64(),
             "keys": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {b"": 0}  # number 0 is the end, which is no word
        counts, grams, seq, pos, part, schema = np.zeros(1 << 16, np.int64), GramCounts(), 0, 0, 0, None
        pack = zstandard.ZstdCompressor(1)

        def close() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for lo in range(0, len(words), 100_000):
                hi = min(len(words), lo + 100_000)
                yield _padded({"part": np.full(hi - lo, part), "seq": np.full(hi - lo, seq), "local": np.arange(lo, hi),
                               "word": words[lo:hi], "c": counts[lo:hi]}, hi - lo, schema)
            grams.merge()
            keys, c = grams.done
            seen = c > 0
            short, n = merged([(keys[seen] & ((1 << (8 * (HEAD + 1))) - 1), c[seen])])
            yield _padded({"part": np.full(len(n), part), "seq": np.full(len(n), seq), "gram": short, "c": n}, len(n), schema)
            at = bucket_of(keys, buckets)
            order = np.argsort(at, kind="stable")
            keys, c, at = keys[order], c[order], at[order]
            edges = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(at)] if len(at) else []):
                yield _padded({"part": [part], "seq": [seq], "bucket": [at[lo]], "keys": [pack.compress(keys[lo:hi].tobytes())],
                               "counts": [pack.compress(c[lo:hi].tobytes())]}, 1, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if schema is None:
                part = batch.column("part")[0].as_py()
                types = {"doc_id": batch.column("doc_id").type} | kinds
                schema = pa.schema([(name, types[name]) for name, _ in fields])
            held = batch.column("held_out").to_pylist()
            waiting: tuple[list[bytes], list[bytes]] = ([], [])
            seqs, bodies, size = [], [], 0
            for data, out in zip(text_bytes(batch), held):
                words = data.lower().split()
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                if len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(numbers)), np.int64)])
                if not out:
                    local, often = np.unique(np.append(ids, 0), return_counts=True)
                    counts[local] += often
                text = b" ".join(words)
                waiting[out].append(text)
                seqs.append(seq)
                bodies.append(pack.compress(text))
                size += len(text)
                if size >= PIECE_BYTES or len(bodies) == batch.num_rows:
                    for texts, training in zip(waiting, (True, False)):
                        grams.add(texts, training)
                    waiting, size = ([], []), 0
                    if len(numbers) >= VOCABULARY or len(grams.done[0]) >= BLOCK_GRAMS:
                        yield from close()
                        numbers, grams, seq = {b"": 0}, GramCounts(), seq + 1
                        counts[:] = 0
            yield _padded({"part": np.full(len(seqs), part), "seq": seqs, "pos": np.arange(pos, pos + len(seqs)),
                           "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "body": bodies},
                          len(seqs), schema)
            pos += len(seqs)
        if schema is not None:
            yield from close()

    return docs.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def gram_logs(packs: DataFrame, head: Tree) -> DataFrame:
    """(part, seq, bucket, logs): for every block the log10 probabilities of its grams, in the order of ``keys``, from counts
    (part, seq, bucket, keys, counts) of all blocks."""
    shared = packs.sparkSession.sparkContext.broadcast(head)

    def run(group: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(1)
        keys, counts = ([np.frombuffer(unpack.decompress(b.as_py()), np.int64) for b in group.column(name)]
                        for name in ("keys", "counts"))
        grams, total = merged(list(zip(keys, counts)))
        logs = np.log10(branch(shared.value, grams, total).probability(grams)).astype(np.float32)
        back = [pack.compress(logs[np.searchsorted(grams, k)].tobytes()) for k in keys]
        return pa.table({"part": group.column("part"), "seq": group.column("seq"), "bucket": group.column("bucket"),
                         "logs": pa.array(back, pa.binary())})

    return packs.groupBy("bucket").applyInArrow(run, "part long, seq int, bucket long, logs binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens) for every document.

    Words and grams are counted in blocks of bounded size. Words of all blocks meet by word, where a window adds the counts
    of the training texts, grams meet in buckets (:func:`gram_logs`), and both go back to their blocks. So a frequent word
    has a row for each block, not for each text, and no task holds more than one block.

    A null text is an empty one (its only token is the end). Repeated rows are scored, and counted, as often as they
    come; null identifiers are training rows; other columns are left out. No documents give no rows.
    """
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    rows = keep(blocks_of(docs.select("doc_id", "text", held.alias("held_out"),
                                      F.spark_partition_id().cast("long").alias("part")), size // BUCKET_BYTES + 1))
    head = grow(keep(rows.where("gram is not null").groupBy("gram").agg(F.sum("c").alias("c"))))
    packs = rows.where("bucket is not null").select("part", "seq", "bucket", "keys", "counts")
    logs = keep(gram_logs(packs, head))
    by_word = W.partitionBy("word")
    place = F.struct("part", "seq")
    summed = keep(rows.where("local is not null").select(
        "part", "seq", "local", F.sum("c").over(by_word).alias("c"), (F.min(place).over(by_word) == place).alias("first")))
    n, v = summed.where("first and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    texts = rows.where("body is not null").select("part", "seq", "pos", "doc_id", "held_out", "body")
    both = summed.drop("first")
    for other in (packs.drop("counts"), logs, texts):
        both = both.unionByName(other, allowMissingColumns=True)
    both = (both.withColumn("turn", F.coalesce("pos", F.lit(-1))).repartition("part", "seq")
            .sortWithinPartitions("part", "seq", "turn", "local", "bucket"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        at, numbers, pieces, keys, chances, known, cost = None, {}, [], [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            is_text, is_word = (np.asarray(batch.column(c).is_valid()) for c in ("body", "local"))
            place = np.stack([np.asarray(batch.column(c), np.int64) for c in ("part", "seq")], axis=1)
            edges = np.flatnonzero(np.any(np.diff(place, axis=0) != 0, axis=1)) + 1
            sizes, n_known, base, scores = [], [], [], []
            for lo, hi in zip([0, *edges], [*edges, len(place)]):
                if tuple(place[lo]) != at:
                    at, numbers, pieces, keys, chances, known = tuple(place[lo]), {b"": 0}, [], [], [], None
                part, words_here, texts_here = batch.slice(lo, hi - lo), is_word[lo:hi], is_text[lo:hi]
                if words_here.any():
                    pieces.append(np.asarray(part.column("c").filter(pa.array(words_here))))
                packed = part.filter(pa.array(~words_here & ~texts_here))
                for row in packed.select(["keys", "logs"]).to_pylist():
                    for name, kind, into in (("keys", np.int64, keys), ("logs", np.float32, chances)):  # both by bucket
                        if row[name] is not None:
                            into.append(np.frombuffer(unpack.decompress(row[name]), kind))
                if not texts_here.any():
                    continue
                if known is None:
                    known = np.concatenate(pieces)
                    cost = np.log10((known + 1) / (n + v + 1))
                    keys, chances = np.concatenate(keys), np.concatenate(chances).astype(np.float64)
                    order = np.argsort(keys, kind="stable")
                    keys, chances = keys[order], chances[order]
                texts = [unpack.decompress(b.as_py()) for b in part.column("body").filter(pa.array(texts_here))]
                for text in texts:
                    words = text.split()
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    ids = np.append(ids, 0)
                    sizes.append(len(ids))
                    n_known.append(int((known[ids] > 0).sum()))
                    base.append(float(cost[ids].sum()))
                scores.extend(log10_scores(keys, chances, texts))
            some = batch.filter(pa.array(is_text))
            new = {"n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                   "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else some.column(c) for c in names], names=names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in names[2:4]),
                           *(T.StructField(c, T.DoubleType()) for c in names[4:])])
    return both.mapInArrow(look_up, schema).withColumn("train_tokens", F.lit(n).cast("long"))


def op1(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
