"""Near-duplicates by SetSketch registers: exponentially spaced, truncated minima.

A document's set is its distinct five-word shingles. Every shingle is a Poisson process of points, each of which falls on
one of ``REGISTERS`` registers; a register keeps its smallest point on a logarithmic scale (base ``BASE``, cut to 16
bits). Equal registers happen about as often as the Jaccard similarity, and a sketch of a union is the maximum of the
registers. Bands of six registers nominate pairs, the likelihood of the counts of larger, equal and smaller registers
rules out dissimilar ones, and full sets decide.

A set also has ``PARITY`` bits: whether the number of its elements that hash to each is odd. Bits in which two sets
differ are at most as many as the elements that only one of them has, so this rules out pairs without ever losing a link.

At similarity 0.75, 48 bands of six registers miss a pair with probability (1 - 0.75^6)^48 = 8e-5; the likelihood test
at 0.6 is about six standard errors away.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tilewright.llm.common import join_groups, keep, per_batch, sieve, table, text_bytes
from tilewright.llm.components import joined

SHINGLE = 5
LEAST_PERCENT = 75
ROWS, BANDS = 6, 48
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65_535
LEAST_ESTIMATE = 0.6
PARITY = 1024            # bits of parity
ROUNDS = 2               # rounds in which members meet centres
SLOTS, CENTRES = 2, 4    # centres of a bucket after the first round, and those that a member meets in each
PAIRS_PER_ENTRY = 0.02   # pairs across components for each bucket entry, from which no second round is needed
MEMBERS_PER_TASK = 256   # members compared with one copy of a centre
BATCH_ELEMENTS = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], hashes: _Words) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        total = total * _GOLDEN + ids[i:len(ids) - size + 1 + i]
    return np.unique(_mix(total))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (16 bits) of every set, one row each; sets must not be empty."""
    n = len(sets)
    minima = np.full(n * REGISTERS, np.inf)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    at = np.zeros(len(element))
    shift = 0
    while len(element):
        shift = (shift + int(_GOLDEN)) % 2 ** 64
        draw = _mix(element + np.uint64(shift))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53
        at = at - np.log(uniform) / (RATE * REGISTERS)
        register = (_mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(minima, owner * REGISTERS + register, at)
        limit = minima.reshape(n, REGISTERS).max(axis=1)  # later points only matter below the largest minimum
        open_ = at < limit[owner]
        element, owner, at = element[open_], owner[open_], at[open_]
    scale = np.floor(1.0 - np.log(minima) / np.log(BASE))
    return np.clip(scale, 0, TOP).astype(np.uint16).reshape(n, REGISTERS)


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """For every set and bit, whether the number of its elements at that bit is odd, packed in 64-bit integers."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(owner * PARITY + at, minlength=len(sets) * PARITY) % 2
    return np.packbits(odd.astype(bool).reshape(len(sets), PARITY), axis=1).view(np.int64)


def may_link(x: str, y: str) -> Column:
    """Whether sizes and parities (``n`` and ``p`` with the side's name) leave a link possible; it is for every link.

    With S the sum of the sizes and D the number of elements that only one set has, similarity is (S - D) / (S + D).
    """
    nx, ny, least = F.col(f"n{x}"), F.col(f"n{y}"), LEAST_PERCENT
    differing = reduce(add, (F.bit_count(F.get(f"p{x}", i).bitwiseXOR(F.get(f"p{y}", i))) for i in map(F.lit, range(PARITY // 64))))
    return (100 * F.least(nx, ny) >= least * F.greatest(nx, ny)) & ((100 + least) * differing <= (100 - least) * (nx + ny))


def _sketch_batch(batch: pa.RecordBatch) -> dict:
    hashes, sizes, registers, parities = _Words(), [], [], []
    waiting: list[np.ndarray] = []

    def flush() -> None:
        if waiting:
            registers.extend(sketch(waiting).view(np.int16))
            parities.extend(parity(waiting))
            waiting.clear()

    held = 0
    for data in text_bytes(batch):
        found = shingle_hashes(data.lower().split(), hashes)
        sizes.append(len(found))
        if len(found):
            waiting.append(found)
            held += len(found)
        else:
            flush()
            registers.append(None)
            parities.append(None)
        if held >= BATCH_ELEMENTS or len(waiting) >= 4096:
            flush()
            held = 0
    flush()
    return {"n_shingles": sizes, "registers": registers, "parity": parities}


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from the registers of both and the known sizes, on a grid."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - larger - smaller
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def chance(x: np.ndarray) -> np.ndarray:  # that a register differs in one direction
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    parts = ((larger, up), (smaller, down), (equal, 1 - up - down))
    likelihood = sum(k[:, None] * np.log(np.maximum(p, 1e-12)) for k, p in parts)
    return np.take_along_axis(grid, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and parities allow the similarity and whose registers make it likely."""
    def side(x: str) -> DataFrame:
        return sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"s{x}"),
                               F.col("parity").alias(f"p{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b")).select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.asarray(batch.column(c).flatten()).view(np.uint16).reshape(-1, REGISTERS)
                               for c in ("sa", "sb"))
                sizes = (np.asarray(batch.column(c), np.float64) for c in ("na", "nb"))
                found = estimate(left, right, *sizes)
                yield batch.select(["a", "b"]).filter(pa.array(found >= LEAST_ESTIMATE))

    return both.mapInArrow(run, "a long, b long")


def shingle_set(data: bytes) -> set:
    words = data.lower().split()
    return set(zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)} if words else set()


def linked(a: set, b: set) -> bool:
    common = len(a & b)
    return common > 0 and 100 * common >= LEAST_PERCENT * (len(a) + len(b) - common)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets, as (u, v).

    Rows are sorted so that a centre's text comes right before its members'; a task holds one centre's set at a time. A
    centre with many members is copied for every ``MEMBERS_PER_TASK`` of them.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).alias("parts"))
    dealt = pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b")
    centres = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                            F.lit(None).cast("long").alias("b"))
    wanted = dealt.unionByName(centres).withColumn("node", F.coalesce("b", "a"))
    rows = wanted.join(texts, "node").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: set = set()
        for batch in batches:
            out = []
            nodes = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
            for (a, b), data in zip(nodes, text_bytes(batch)):
                if b is None:
                    centre = shingle_set(data)
                elif linked(centre, shingle_set(data)):
                    out.append((a, b))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row, digest, n_shingles, registers, parity; nodes: digest, node, _n). Equal texts are one node."""
    rows = per_batch(docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")),
                     _sketch_batch, ["doc_id", "digest"],
                     [("n_shingles", T.LongType()), ("registers", T.ArrayType(T.ShortType())), ("parity", T.ArrayType(T.LongType()))])
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
    nodes = (rows.where("n_shingles > 0").groupBy("digest")
             .agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("_n")))
    return rows, keep(nodes)


def _members() -> list:
    """Sums that tell sets of nodes apart, whatever their order."""
    return [F.expr("sum(cast(xxhash64(node) as decimal(38,0)))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")]


def links(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components (node, label) of the nodes with a similar other text.

    A node is as popular as its buckets are large in sum. Every member of a bucket meets the most popular ones of its
    buckets and is compared with them in full, which is linear in the input and connects copies with what they are
    copies of, however many there are; where much is still open, other centres are met in a second round. Then the pairs
    of a bucket that are still in different components are compared, so no link between components is lost. Parities
    rule out most of these in the join itself.
    """
    spark = docs.sparkSession
    n_entries = nodes.count() * BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                        lambda i: F.xxhash64(i, F.slice("registers", i * ROWS + 1, ROWS)))
    entries = rows.where("n_shingles > 0").select(F.col("row").alias("node"), F.xxhash64("digest").alias("d"),
                                                  F.explode(bands).alias("bucket"))
    texts_in = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    shared = keep(texts_in.where("lo != hi").select("bucket", "_n"))
    # kept in between, else the copies are looked for among all entries
    found = keep(join_groups(sieve(entries.drop("d"), "bucket", shared, "bucket"), shared, "bucket", rows.count() * BANDS))
    found = keep(found.join(nodes.select("node"), "node", "left_semi"))
    sizes = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), *_members())
    # of buckets with the same members one is enough
    once = keep(sizes.groupBy("_n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "_n", F.col("_n").alias("size")))
    placed = keep(join_groups(found, once, "bucket", n_entries))
    popular = keep(placed.groupBy("node").agg(F.sum("size").alias("popular")))
    members = placed.select("node", "bucket").join(popular, "node")
    sketches = keep(sieve(rows.withColumnRenamed("row", "node"), "node", popular, "node").join(popular, "node")
                    .select("node", "doc_id", "digest", "n_shingles", "registers", "parity"))
    wanted = sketches.select("node", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    hashed = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_d"))
    texts = keep(sieve(hashed, "_d", wanted, "_digest")
                 .join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")))
                 .select("node", "text"))
    label = spark.createDataFrame([], "node long, label long")
    tested = spark.createDataFrame([], "a long, b long")
    open_ = keep(members.withColumn("label", F.col("node")))
    for turn in range(ROUNDS):
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(SLOTS if turn else 1)).alias("slot")
        best = F.max_by(F.struct("node", "label", "popular"), F.struct("popular", -F.col("node"))).alias("c")
        centres = open_.groupBy("bucket", slot).agg(best).select(
            "bucket", F.col("c.node").alias("a"), F.col("c.label").alias("la"), F.col("c.popular").alias("pa"))
        met = open_.join(centres, "bucket").where(F.col("label") != F.col("la"))
        few = F.slice(F.sort_array(F.collect_set(F.struct("pa", "a")), asc=False), 1, CENTRES)  # of BANDS * SLOTS at most
        pairs = met.groupBy(F.col("node").alias("b")).agg(few.alias("c")).select(F.explode("c.a").alias("a"), "b")
        near = keep(likely(not_in(pairs, tested) if turn else pairs, sketches))
        tested = tested.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        label = joined(label, keep(verify(near, texts)))
        open_, cross = still_open(members, label, n_entries)
        if cross <= PAIRS_PER_ENTRY * n_entries:
            break
    if not cross:
        return label
    side = keep(open_.join(sketches.select("node", "n_shingles", "parity"), "node"))

    def named(x: str) -> DataFrame:
        return side.select("bucket", F.col("node").alias(x), F.col("label").alias(f"l{x}"),
                           F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))

    across = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & may_link("a", "b")
    left = named("a").join(named("b").withColumnRenamed("bucket", "_bucket"), (F.col("bucket") == F.col("_bucket")) & across)
    left = keep(likely(not_in(left.select("a", "b").distinct(), tested), sketches))
    more = keep(verify(left, texts))
    return joined(label, more) if more.head(1) else label


def not_in(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs that were not compared yet, whichever way round."""
    done = tested.select(F.col("a").alias("_lo"), F.col("b").alias("_hi")).distinct()
    return pairs.join(done, (F.least("a", "b") == F.col("_lo")) & (F.greatest("a", "b") == F.col("_hi")), "left_anti")


def still_open(members: DataFrame, label: DataFrame, total: int) -> tuple[DataFrame, int]:
    """The members, with labels, of buckets with more than one component, and the number of pairs across components."""
    known = keep(members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    counts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    buckets = keep(counts.groupBy("bucket").agg(F.sum("k").alias("_n"), F.sum(F.col("k") * F.col("k")).alias("same"),
                                                F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels"))
    cross = buckets.agg(F.sum((F.col("_n") * F.col("_n") - F.col("same")) / 2)).head()[0] or 0
    return keep(join_groups(known, buckets.drop("same"), "bucket", total)), int(cross)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and ``digest`` (of the text),
    ``first`` (the row that stands for its component).

    Documents without words are components of their own. A component's id is its smallest identifier; documents whose
    identifier is null count, but never give it unless all are null (then it is null and ``kept`` is ``first``). Rows
    that repeat an identifier and its text are all kept by the contract, but only one is ``first``. Other columns are
    left out; no documents give no rows.
    """
    rows, nodes = classes(docs)
    label = links(docs, rows, nodes)
    placed = nodes.join(label, "node", "left").select("digest", F.coalesce("label", "node").alias("component"), "_n")
    narrow = rows.select("doc_id", "row", "digest", "n_shingles")
    total = rows.count()
    grouped = join_groups(narrow.where("n_shingles > 0"), placed, "digest", total)
    alone = narrow.where("n_shingles = 0").withColumn("component", F.col("row"))
    member = keep(grouped.unionByName(alone))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    heads = member.groupBy("component").agg(F.min(order).alias("h"), F.count(F.lit(1)).alias("_n")).select(
        "component", F.col("h.doc_id").alias("component_id"), F.col("h.row").alias("_row"), "_n")
    first = F.col("row") == F.col("_row")
    return join_groups(member, heads, "component", total).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                                         F.col("component_id").isNull() & first).alias("kept"),
        "digest", first.alias("first"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, with its columns."""
    found = near_duplicates(docs)
    gone = found.where(~F.col("first")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    stays = found.where("first").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.select(F.struct(*docs.columns).alias("r"), F.col("doc_id").alias("_i"),
                       F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_d"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest"))
    kept = rows.join(gone, same, "left_anti")
    # Rows that repeat both identifier and text are on both lists; one of each stays.
    twice = keep(gone.distinct().intersect(stays))
    if twice.head(1):
        kept = kept.unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["_i", "_d"]))
    return kept.select("r.*")


OP5_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents),
s as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),
        lambda i: array_to_string(w[i:i + 4], ' '))) as s from w),
n as (select doc_id, len(s)::bigint as n_shingles from s),
x as (select doc_id, unnest(s) as shingle from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common
      from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b
      where 100 * common >= 75 * (na.n_shingles + nb.n_shingles - common)),
both_ways as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as seen from n union select r.doc_id, b from r join both_ways on a = seen),
k as (select doc_id, min(seen) as component_id from r group by doc_id)
select n.doc_id, n_shingles, component_id, n.doc_id = component_id as kept from n join k on n.doc_id = k.doc_id
"""
