"""Removal of repeated passages, found level by level: windows that repeat at one length alone are extended to twice it.

A window of ``window`` words repeats only if everything in it does. So at a short length each window is represented by
the sub-window of least name among its own, a choice that depends on its words alone; it stays a candidate while its
representative occurs twice anywhere. The names of the next length are made from two names of this one, and only
candidates have them. When the length reaches the window, representatives are the windows themselves, and the first
occurrence of each is looked up.

Names are 64-bit hashes. At every level a block of documents sends the distinct names of its representatives to buckets,
as packed arrays; a bucket sends back those that occur elsewhere too. A passage with any number of copies is one name
for each block, and no list of its places is ever gathered. False matches at short lengths only leave a candidate for
the next one; for the last length, bucket and name come from independent hashes, so their joint width grows with the
number of buckets and thus with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.common import discard, keep, table

WINDOW, START = 20, 5
BLOCK_BITS = 10                  # a block is this many bits of consecutive row numbers
WORDS_AT_ONCE = 2_000_000        # words of a block that are worked on together
BYTES_PER_BUCKET = 1 << 24       # text for each bucket
LEAST_BUCKETS = 64

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SALTS = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NOBODY = np.iinfo(np.int64).max   # a null identifier comes last


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordNames(dict):
    """word -> 64-bit hash, remembered; starts anew when half a million words are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def first_names(ids: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of ``length`` words."""
    n = max(0, len(ids) - length + 1)
    total = np.full(n, np.uint64(length))
    for i in range(length):
        total = total * _GOLDEN + ids[i:i + n]
    return mix(total)


def doubled(names: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Names of windows twice as long, in the places of their first halves; the last places stay 0."""
    out = np.zeros(len(names), np.uint64)
    if len(names) > length:
        out[:-length] = mix(mix(names[:-length] + _SALTS[salt]) * _GOLDEN + names[length:])
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[:n], x[width - have:width - have + n])


def represent(at: np.ndarray, names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of the ``width`` names from each place ``at``, and the places that are the least for some of them."""
    if width == 1 or not len(at):
        return names[at], at
    least = sliding_min(names, width)[at]
    over = np.zeros(len(names) + width - 1, np.uint64)
    over[at + width - 1] = least
    return least, np.flatnonzero(~sliding_min(~over, width) == names)


def places(candidates: np.ndarray, extra: int) -> np.ndarray:
    """Where each candidate's name stands, when the names of a document are held for it and the ``extra`` windows after it."""
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(candidates), extra + 1))]) if len(candidates) else candidates


def covered(at: np.ndarray, reach: int, n: int) -> np.ndarray:
    """Marks of the places that are in ``at`` or less than ``reach`` after one of them."""
    steps = np.zeros(n + reach + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + reach, -1)
    return np.cumsum(steps)[:n] > 0


def packed(candidates: np.ndarray) -> bytes:
    """First and last place of each run of neighbours."""
    breaks = np.flatnonzero(np.diff(candidates) != 1)
    edges = np.stack([candidates[np.concatenate([[0], breaks + 1])], candidates[np.concatenate([breaks, [-1]])]], axis=1)
    return edges.astype(np.int32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    first, last = np.frombuffer(data, np.int32).reshape(-1, 2).astype(np.int64).T
    counts = last - first + 1
    return np.arange(counts.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)


class Documents:
    """Some documents of one block, end to end: row numbers, candidate starts and the names held for them."""

    def __init__(self, rows: list[int], candidates: list[np.ndarray], names: list[np.ndarray], extra: int):
        self.rows = np.array(rows, np.int64)
        self.candidates, self.extra = candidates, extra
        counts = [len(c) for c in candidates]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in names])])[:len(names)].astype(np.int64)
        self.of = np.repeat(np.arange(len(rows)), counts)
        self.at = np.concatenate([places(c, extra) + s for c, s in zip(candidates, starts)] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.ends = np.cumsum(counts)[:-1] if counts else []

    def extended(self, stays: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, candidates, names of twice the length) of the documents where a candidate stays."""
        extra = self.extra - length
        longer = doubled(self.names, length)
        for k, (starts, keeps, at) in enumerate(zip(self.candidates, np.split(stays, self.ends), np.split(self.at, self.ends))):
            if keeps.any():
                first, last = at[0], at[-1] + extra + 1
                held = covered(at[keeps] - first, extra + 1, last - first)
                yield k, starts[keeps], longer[first:last][held]


def _cut(data: bytes) -> list[bytes]:
    return data.split()


def from_words(rows: list[int], texts: list[list[bytes]], names: WordNames, window: int, start: int) -> Documents:
    """Every window of every text is a candidate."""
    ids = [np.fromiter(map(names.__getitem__, words), np.uint64, len(words)) for words in texts]
    candidates = [np.arange(max(0, len(words) - window + 1)) for words in texts]
    # the names that candidates need, so that places() agrees
    held = [first_names(x, start) if len(x) >= window else np.zeros(0, np.uint64) for x in ids]
    return Documents(rows, candidates, held, window - start)


def requests(block: int, docs: Documents, owners: np.ndarray, length: int, window: int, buckets: int) -> Iterator[tuple]:
    """(bucket, block, names, several, owner, row): what a block asks, for each bucket.

    ``owner`` and ``row`` are those of the block's first document with the name, and only sent for the last length.
    """
    _, chosen = represent(docs.at, docs.names, window - length + 1)
    names = docs.names[chosen]
    last = length == window
    if last:
        order = np.lexsort((docs.rows[docs.of], owners[docs.of]))
        names, of = names[order], docs.of[order]
    unique, first, counts = np.unique(names, return_index=True, return_counts=True)
    bucket = ((mix(unique + _SALTS[1]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    inside = of[first] if last else None
    order = np.lexsort((unique, inside, bucket)) if last else np.lexsort((unique, bucket))
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for some in np.split(order, edges[1:]) if len(order) else []:
        own = (owners[inside[some]].tobytes(), docs.rows[inside[some]].tobytes()) if last else (None, None)
        yield int(bucket[some[0]]), block, unique[some].tobytes(), np.packbits(counts[some] > 1).tobytes(), *own


REQUEST = "bucket int, block long, names binary, several binary, owner binary, row binary"
ANSWER = "block long, names binary, row binary"
_ANSWER_TYPES = {"block": pa.int64(), "names": pa.binary(), "row": pa.binary()}


def _batch(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    data = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, columns.values())], names=list(columns))


def _answers(blocks: list[int], sent: list[tuple]) -> Iterator[tuple]:
    """(block, names, row): the names of each block that occur twice or more, and the row of the first document with them."""
    names = [np.frombuffer(s[0], np.uint64) for s in sent]
    several = np.concatenate([np.unpackbits(np.frombuffer(s[1], np.uint8), count=len(n)) for s, n in zip(sent, names)])
    sizes = [len(n) for n in names]
    whole = np.concatenate(names)
    unique, inverse = np.unique(whole, return_inverse=True)
    seen = np.bincount(inverse, weights=1 + several)
    row = None
    if sent[0][2] is not None:
        owner, rows = (np.concatenate([np.frombuffer(s[k], np.int64) for s in sent]) for k in (2, 3))
        order = np.lexsort((rows, owner, inverse))
        firsts = order[np.flatnonzero(np.diff(inverse[order], prepend=-1))]
        row = rows[firsts][inverse]
    hit = seen[inverse] > 1
    for block, lo, hi in zip(blocks, np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes)):
        if hit[lo:hi].any():
            mine = slice(lo, hi)
            yield block, whole[mine][hit[mine]].tobytes(), None if row is None else row[mine][hit[mine]].tobytes()


def answered(asked: DataFrame) -> DataFrame:
    """Answers to all requests. A bucket holds at most its share of the names, however often each occurs."""
    rows = asked.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, sent = None, [], []
        for batch in batches:
            for bucket, block, *what in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "names", "several", "owner", "row"))):
                if bucket != at and sent:
                    yield _batch(_ANSWER_TYPES, list(_answers(blocks, sent)))
                    blocks, sent = [], []
                at = bucket
                blocks.append(block)
                sent.append(what)
        if sent:
            yield _batch(_ANSWER_TYPES, list(_answers(blocks, sent)))

    return rows.mapInArrow(run, ANSWER)


def _owner(doc_id) -> int:
    return _NOBODY if doc_id is None else doc_id


_REQUEST_TYPES = {"bucket": pa.int32(), "block": pa.int64(), "names": pa.binary(), "several": pa.binary(), "owner": pa.binary(), "row": pa.binary()}


def ask_texts(rows: DataFrame, window: int, start: int, buckets: int) -> DataFrame:
    """Requests of the first level, from (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        numbers, texts, held, block = [], [], 0, None

        def out() -> pa.RecordBatch:
            nonlocal held
            docs = from_words(numbers, texts, names, window, start)
            found = _batch(_REQUEST_TYPES, list(requests(block, docs, np.zeros(len(numbers), np.int64), start, window, buckets)))
            numbers.clear()
            texts.clear()
            held = 0
            return found

        for batch in batches:
            for row, data in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if numbers and (row >> BLOCK_BITS != block or held >= WORDS_AT_ONCE):
                    yield out()
                block = row >> BLOCK_BITS
                words = _cut(data or b"")
                if len(words) >= window:
                    numbers.append(row)
                    texts.append(words)
                    held += len(words)
        if numbers:
            yield out()

    return rows.select("row", "text").mapInArrow(run, REQUEST)


def _state(batch: pa.RecordBatch) -> Iterator[tuple]:
    columns = (batch.column(c).to_pylist() for c in ("row", "doc_id", "candidates", "names"))
    for row, doc_id, candidates, names in zip(*columns):
        yield row, doc_id, unpacked(candidates), np.frombuffer(names, np.uint64)


def ask_states(states: DataFrame, window: int, length: int, buckets: int) -> DataFrame:
    """Requests of a later level, from (row, doc_id, candidates, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, owners, candidates, names, held, block = [], [], [], [], 0, None

        def out() -> pa.RecordBatch:
            nonlocal held
            docs = Documents(numbers, candidates, names, window - length)
            found = _batch(_REQUEST_TYPES, list(requests(block, docs, np.array(owners, np.int64), length, window, buckets)))
            for x in (numbers, owners, candidates, names):
                x.clear()
            held = 0
            return found

        for batch in batches:
            for row, doc_id, some, own in _state(batch):
                if numbers and (row >> BLOCK_BITS != block or held >= WORDS_AT_ONCE):
                    yield out()
                block = row >> BLOCK_BITS
                numbers.append(row)
                owners.append(_owner(doc_id))
                candidates.append(some)
                names.append(own)
                held += len(own)
        if numbers:
            yield out()

    return states.select("row", "doc_id", "candidates", "names").mapInArrow(run, REQUEST)


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of a block right after the answers to it, in one partition: kind 0 (answers), then the rows by number."""
    block = F.shiftright("row", BLOCK_BITS)
    mine = rows.withColumn("block", block).withColumnRenamed("row", "number").withColumn("kind", F.lit(1))
    theirs = answers.withColumnRenamed("names", "hits").withColumnRenamed("row", "first").withColumn("kind", F.lit(0))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    order = ["block", "kind", "number"] + (["step"] if "step" in rows.columns else [])
    return both.repartition("block").sortWithinPartitions(*order)


class Hits:
    """The answers of one block, looked up by name."""

    def __init__(self):
        self.block, self.parts, self.rows, self.sorted = None, [], [], None

    def add(self, block: int, names: bytes, row: bytes | None) -> None:
        if block != self.block:
            self.block, self.parts, self.rows = block, [], []
        self.sorted = None
        self.parts.append(np.frombuffer(names, np.uint64))
        if row is not None:
            self.rows.append(np.frombuffer(row, np.int64))

    def find(self, block: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Which names are answered, and the row of the first document with them."""
        if block != self.block or not self.parts:
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        if self.sorted is None:
            whole = np.concatenate(self.parts)
            order = np.argsort(whole, kind="stable")
            self.sorted = whole[order], np.concatenate(self.rows)[order] if self.rows else None
        known, rows = self.sorted
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        return known[at] == names, None if rows is None else rows[at]


def _survivors(hits: Hits, block: int, docs: Documents, window: int, length: int) -> Iterator[tuple[int, bytes, bytes]]:
    least, _ = represent(docs.at, docs.names, window - length + 1)
    stays, _ = hits.find(block, least)
    for k, starts, names in docs.extended(stays, length):
        yield k, packed(starts), names.tobytes()


def first_states(rows: DataFrame, answers: DataFrame, window: int, start: int) -> DataFrame:
    """(row, doc_id, candidates, names) of the documents where a window is left. Candidates are held as runs, for most
    are neighbours."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "candidates": pa.binary(), "names": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hits = WordNames(), Hits()
        numbers, ids, texts, held, block = [], [], [], 0, None

        def out() -> pa.RecordBatch:
            nonlocal held
            docs = from_words(numbers, texts, names, window, start)
            found = [(numbers[k], ids[k], *rest) for k, *rest in _survivors(hits, block, docs, window, start)]
            for x in (numbers, ids, texts):
                x.clear()
            held = 0
            return _batch(kinds, found)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "kind", "number", "doc_id", "hits")]
            data = batch.column("text").cast(pa.binary()).to_pylist()
            for here, kind, number, doc_id, answer, text in zip(*columns, data):
                if numbers and (here != block or held >= WORDS_AT_ONCE):
                    yield out()
                block = here
                if kind == 0:
                    hits.add(here, answer, None)
                    continue
                words = _cut(text or b"")
                if len(words) >= window:
                    numbers.append(number)
                    ids.append(doc_id)
                    texts.append(words)
                    held += len(words)
        if numbers:
            yield out()

    joined = with_answers(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text"),
                          answers.select("block", "names", F.lit(None).cast("binary").alias("row")))
    return joined.mapInArrow(run, "row long, doc_id long, candidates binary, names binary")


def next_states(states: DataFrame, answers: DataFrame, window: int, length: int) -> DataFrame:
    """(row, doc_id, candidates, names of twice the length) of the documents where a window is left."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "candidates": pa.binary(), "names": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits()
        numbers, ids, candidates, names, held, block = [], [], [], [], 0, None

        def out() -> pa.RecordBatch:
            nonlocal held
            docs = Documents(numbers, candidates, names, window - length)
            found = [(numbers[k], ids[k], *rest) for k, *rest in _survivors(hits, block, docs, window, length)]
            for x in (numbers, ids, candidates, names):
                x.clear()
            held = 0
            return _batch(kinds, found)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "kind", "number", "doc_id", "hits", "candidates", "names")]
            for here, kind, number, doc_id, answer, some, own in zip(*columns):
                if numbers and (here != block or held >= WORDS_AT_ONCE):
                    yield out()
                block = here
                if kind == 0:
                    hits.add(here, answer, None)
                else:
                    numbers.append(number)
                    ids.append(doc_id)
                    candidates.append(unpacked(some))
                    names.append(np.frombuffer(own, np.uint64))
                    held += len(names[-1])
        if numbers:
            yield out()

    joined = with_answers(states.select("row", F.col("doc_id").cast("long").alias("doc_id"), "candidates", "names"),
                          answers.select("block", "names", F.lit(None).cast("binary").alias("row")))
    return joined.mapInArrow(run, "row long, doc_id long, candidates binary, names binary")


def later_windows(row: int, block: int, candidates: np.ndarray, names: np.ndarray, hits: Hits) -> np.ndarray:
    """Starts of the windows whose words also start earlier."""
    hit, first = hits.find(block, names)
    own = np.zeros(len(names), bool)
    own[np.unique(names, return_index=True)[1]] = True  # the first place in this document
    return candidates[hit & ~(own & (first == row))]


def spans_of(marks: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def without_repeats(rows: DataFrame, states: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, n_words, n_removed, spans, kept) of all documents; ``states`` has those that may lose words."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(),
             "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, later = Hits(), (None, np.zeros(0, np.int64))
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("block", "kind", "number", "step", "doc_id", "hits", "first", "candidates", "names")]
            data = batch.column("text").cast(pa.binary()).to_pylist()
            for block, kind, row, step, doc_id, answer, first, candidates, names, text in zip(*columns, data):
                if kind == 0:
                    hits.add(block, answer, first)
                elif step == 0:
                    later = row, later_windows(row, block, unpacked(candidates), np.frombuffer(names, np.uint64), hits)
                else:
                    words = _cut(text or b"")
                    marks = covered(later[1] if later[0] == row else later[1][:0], window, len(words))
                    out.append((row, doc_id, len(words), int(marks.sum()), spans_of(marks), b" ".join(compress(words, ~marks))))
            yield _batch(kinds, out)

    both = (rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(1).alias("step"))
            .unionByName(states.select("row", "doc_id", "candidates", "names", F.lit(0).alias("step")), allowMissingColumns=True))
    return with_answers(both, answers).mapInArrow(
        run, "row long, doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, start: int = START, stable: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` for every document.

    Each word is removed that a window of ``window`` words covers whose words also start earlier: in a document with a
    smaller ``doc_id`` (an integer; null comes last), or in the same one before. ``window`` must be ``start`` doubled once
    or more. Windows are judged on the input. Null and empty texts have no words and an empty ``kept``; texts
    below one window stay whole. Rows that share an identifier are ordered by their place in the input. Other columns are
    left out, whatever their names; no documents give no rows. ``stable`` says that ``docs`` reads files, so that it has
    the same rows in the same partitions each time; otherwise it is written down first.
    """
    if window not in (start << k for k in range(1, 32)):
        raise ValueError("window must be start, doubled once or more")
    rows = docs.select("doc_id", "text")
    rows = (rows if stable else keep(rows)).withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BYTES_PER_BUCKET)
    answers = keep(answered(ask_texts(rows, window, start, buckets)))
    states, length = keep(first_states(rows, answers, window, start)), 2 * start
    while length < window:
        discard(answers)
        answers = keep(answered(ask_states(states, window, length, buckets)))
        before, states = states, keep(next_states(states, answers, window, length))
        discard(before)
        length *= 2
    discard(answers)
    answers = keep(answered(ask_states(states, window, window, buckets)))
    cut = without_repeats(rows, states, answers, window)
    return cut.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "n_removed", "spans",
                      F.decode("kept", "UTF-8").alias("kept"))


def op11(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), stable=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) as h from d, unnest(range(1, len(w) - 18)) as r(i)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as r from windows) where r > 1),
words as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
gone as (select distinct doc_id, p from (select doc_id, i + unnest(range(20)) as p from later)),
kept as (select words.doc_id, array_to_string(list(w[words.p] order by words.p) filter (gone.p is null), ' ') as kept, count(gone.p) as n_removed
    from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""
