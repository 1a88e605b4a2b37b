"""Spelling variants by dense prefix-suffix tiling.

The words of a corpus are counted; those that are long and frequent enough are compared by tiles. A tile is two blocks of
words as code-point matrices, padded to one width: column by column, every row of one block meets every row of the
other, which gives the length of the common prefix of each pair, and on the right-aligned matrices that of the common
suffix. The two words differ by one inserted, deleted or replaced code point exactly if these lengths together reach the
longer length minus one.

Which words share a tile follows from the same fact: cut the shorter word in halves, and a single edit leaves the first
or the second half whole. So the words of a length and those one longer meet only where such a half is the same. Small
groups are packed side by side into one tile; a group above ``BLOCK`` words is cut into blocks, and every pair of blocks
is a tile of its own, in any task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tilewright.llm.common import join_groups, keep, table, text_bytes

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")
SLIP = 199            # a run whose checksum this divides loses a code point
LEAST_LENGTH, LEAST_COUNT = 6, 5
DOMINANCE = 5         # a form is at least so many times as frequent as its variant
BLOCK = 1024          # words of a block
PACK = 256            # words of small groups that share a tile
HELD = 200_000        # distinct words that a task counts before it passes them on


def spelled(doc_id: str, run: bytes) -> str:
    """The lower-cased run, without one code point if the checksum of identifier and run says so."""
    sum_ = zlib.crc32(f"{doc_id}:".encode() + run)
    word = run.decode()
    if sum_ % SLIP == 0:
        at = sum_ % len(word)
        word = word[:at] + word[at + 1:]
    return word


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often each word of enough code points occurs in all texts, if often enough.

    Null and empty texts have no words; a null identifier reads as the empty text. Repeated rows count each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, data in zip(ids, text_bytes(batch)):
                for found, n in Counter(RUN.findall(data.lower())).items():
                    word = spelled(doc_id or "", found)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the padded code points of the words from their start and from their end."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    width = max(1, int(lengths.max(initial=1)))

    def points(some: list[str]) -> np.ndarray:
        return np.array(some, dtype=f"<U{width}").view(np.uint32).reshape(len(some), width)

    return lengths, points(words), points([w[::-1] for w in words])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading code points of every row of ``a`` and every row of ``b``, padding included."""
    width = min(a.shape[1], b.shape[1])
    same = np.ones((len(a), len(b)), bool)
    length = np.zeros((len(a), len(b)), np.int16)
    for column in range(width):
        same &= a[:, column, None] == b[None, :, column]
        if not same.any():
            break
        length += same
    return length


def single_edits(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs of different words that are one edit apart."""
    la, front_a, back_a = matrices(a)
    lb, front_b, back_b = matrices(b)
    shorter, longer = np.minimum(la[:, None], lb[None, :]), np.maximum(la[:, None], lb[None, :])
    prefix = np.minimum(common(front_a, front_b), shorter)
    suffix = np.minimum(common(back_a, back_b), shorter)
    differ = (prefix < shorter) | (la[:, None] != lb[None, :])
    return np.nonzero(differ & (longer - shorter <= 1) & (prefix + suffix >= longer - 1))


def _tiles(words: DataFrame) -> DataFrame:
    """(length, side, half, i, j, own, word, n): the words of tile (i, j) of the group that shares a half."""
    size = F.char_length("word")
    sides = F.array(*[F.struct((size - less).alias("length"), F.lit(side).alias("side"), half.alias("half"))
                      for less in (0, 1) for side, half in (
                          (0, F.expr(f"left(word, (char_length(word) - {less}) div 2)")),
                          (1, F.expr(f"right(word, char_length(word) - {less} - (char_length(word) - {less}) div 2)")))])
    entries = keep(words.select("word", "n", F.explode(sides).alias("s")).select("s.*", "word", "n")
                   .withColumn("key", F.xxhash64("length", "side", "half")))
    total = entries.count()
    groups = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("m", F.col("_n"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    each = (join_groups(entries, groups, "key", total).withColumns({"own": own, "_b": blocks})
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))))
    return each.select("length", "side", "half", F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own",
                       "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all pairs of (word, n) that are one edit apart."""
    place = ["length", "side", "half", "i", "j"]
    tiles = _tiles(words).repartition(*place).sortWithinPartitions(*place, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[tuple] = []   # whole groups of one block, side by side
        group: list[tuple] = []
        at = None

        def pairs(a: list[tuple], b: list[tuple]) -> pa.RecordBatch:
            left, right = single_edits([w for w, _ in a], [w for w, _ in b])
            one, two = [a[i] for i in left], [b[i] for i in right]
            arrays = [pa.array([w for w, _ in one], pa.string()), pa.array([n for _, n in one], pa.int64()),
                      pa.array([w for w, _ in two], pa.string()), pa.array([n for _, n in two], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n", "near", "near_n"])

        def ended() -> Iterator[pa.RecordBatch]:
            """The group is whole: a pair of blocks is a tile of its own, a single block waits for others."""
            nonlocal packed
            if at and at[3] != at[4]:
                a, b = ([w[:2] for w in group if w[2] == k] for k in (at[3], at[4]))
                yield pairs(a, b)
                yield pairs(b, a)
            elif group:
                packed += [w[:2] for w in group]
                if len(packed) >= PACK:
                    yield pairs(packed, packed)
                    packed = []
            group.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*place, "word", "n", "own")]
            for *here, word, n, own in zip(*columns):
                if here != at:
                    yield from ended()
                    at = here
                group.append((word, n, own))
        yield from ended()
        if packed:
            yield pairs(packed, packed)

    return tiles.mapInArrow(run, "word string, n long, near string, near_n long").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by pointers that reach twice as far in every round.

    Counts grow along a chain by ``DOMINANCE`` at least, so chains are short and without loops.
    """
    steps = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        total = steps.count()
        ahead = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        fans = steps.groupBy(F.col("root").alias("_word")).agg(F.count(F.lit(1)).alias("_n"))
        targets = ahead.join(fans, "_word").withColumnRenamed("_word", "root")
        moved = keep(join_groups(steps, targets, "root", total, "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        steps = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return steps


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the corpus that is long and frequent enough.

    The form of a word is its near word of largest count (ties: the smallest in code-point order), if that is at least
    ``DOMINANCE`` times the word's; the root is the last one of a chain of forms. No documents, or none with such words,
    give no rows. Other columns of the documents are left out, whatever their names.
    """
    words = keep(count_words(docs, least_length, least_count))
    near = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    found = keep(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"), F.max("n").alias("_n"))
                 .select("word", "n_near", (-F.col("b.m")).alias("m"), F.col("b.near").alias("near"), "_n"))
    held = F.col("m") >= DOMINANCE * F.col("_n")
    forms = keep(found.select("word", "n_near", F.when(held, F.col("near")).alias("form"), F.when(held, F.col("m")).alias("form_n")))
    roots = last_forms(forms.where("form is not null"))
    return (words.join(forms, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"))


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], range(8)),
        lambda c, b: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{C0}-\x{FF}]+')) as run from documents),
counted as (select doc_id, run, count(*) as k from runs group by all),
summed as (select run, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
        string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
        lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h from counted, crc),
spelled as (select case when h % 199 = 0 then run[:h % len(run)] || run[h % len(run) + 2:] else run end as word, k from summed),
words as (select word, sum(k)::bigint as n from spelled where len(word) >= 6 group by word having sum(k) >= 5),
cuts as (select word, n, i, word[:i - 1] || word[i + 1:] as cut from words, unnest(range(1, len(word) + 1)) as r(i)),
pairs as (select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from cuts a join words b on a.cut = b.word
    union select b.word, a.word, a.n from cuts a join words b on a.cut = b.word),
best as (select word, near, near_n, count(*) over (partition by word) as n_near,
    row_number() over (partition by word order by near_n desc, near) as r from pairs),
forms as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 5 * w.n then near end as form,
    case when b.near_n >= 5 * w.n then near_n end as form_n from words w left join best b on b.word = w.word and b.r = 1),
chain as (select word, word as seen, 0 as step from forms
    union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.seen where f.form is not null),
ends as (select word, arg_max(seen, step) as root from chain group by word)
select f.word, form, root, n, n_near, form_n from forms f join ends e on e.word = f.word
"""
