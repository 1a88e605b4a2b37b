"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from llm import cases
from tilewright.llm import mixing, sharding

SF = "/root/testdata/sf0.01"


def check_shards(got, shards):
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes


def test_shards_are_near_equal_and_keep_equal_texts_together(spark):
    got = sharding.op6(spark, SF).collect()
    sizes = check_shards(got, 24)
    largest = max(r["size"] for r in got)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    where = defaultdict(set)
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        where[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) - 1 for s in where.values()) <= 23
    again = sharding.op6(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_one_hot_text_is_subdivided(spark):
    docs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    placed = sharding.assign_shards(docs, F.lit(10), 6, F.col("text"), [F.col("id")]).collect()
    counts = defaultdict(int)
    for r in placed:
        counts[r["shard"]] += 1
    assert sorted(counts) == list(range(6)) and max(counts.values()) - min(counts.values()) <= 1


@pytest.mark.parametrize("some", [None, []])
def test_shards_of_odd_rows(spark, tmp_path, some):
    docs = cases.frame(spark, some)
    got = sharding.op6(spark, cases.save(spark, tmp_path, docs)).collect()
    assert len(got) == docs.count()
    check_shards(got, 24)
    staged = sharding.shard_stage(spark, docs, "")
    assert sorted(staged.columns) == sorted(docs.columns) and staged.count() == docs.count()


def plain_level(sizes, weights, budget):
    """Targets by repeated clamping, the long way."""
    targets, clamped = {}, set()
    while True:
        left = budget - sum(2 * sizes[s] for s in clamped)
        total = sum(weights[s] for s in sizes if s not in clamped)
        targets = {s: 2.0 * sizes[s] if s in clamped else weights[s] * left / total for s in sizes}
        above = {s for s in sizes if targets[s] > 2 * sizes[s]}
        if not above:
            return targets
        clamped |= above


def test_mix_follows_targets(spark):
    got = mixing.op8(spark, SF).collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        sizes[sources[r["doc_id"]]] += r["size"]
        taken[sources[r["doc_id"]]] += r["taken"]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = plain_level(sizes, weights, 1.5 * sum(sizes.values()))
    for r in got:
        assert r["target"] == pytest.approx(want[sources[r["doc_id"]]])
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in sizes)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.01)


@pytest.mark.parametrize("some", [None, []])
def test_mix_of_odd_rows(spark, tmp_path, some):
    docs = cases.frame(spark, some)
    got = mixing.op8(spark, cases.save(spark, tmp_path, docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["size"] == 0 for r in got if r["doc_id"] in (5, 6, 7))
    staged = mixing.mix_stage(spark, docs, "")
    assert staged.columns == docs.columns
    staged.collect()


def test_one_source_takes_all_of_its_budget(spark):
    docs = spark.range(50).select(F.lit("s").alias("source"), "id", F.lit(4).alias("n"))
    got = mixing.mix(docs, F.col("n"), F.col("source"), [F.col("id")]).agg(F.sum(F.col("_copies") * 4)).head()[0]
    assert got == 300


def test_many_rows_under_one_identity_flip_one_at_most(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "s" if i % 4 else "t", "w " * (3 + i * 7 % 11 + (500 if i % 97 == 5 else 0))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    path = cases.save(spark, tmp_path, docs)
    got = mixing.op8(spark, path).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    assert Counter(tuple(r) for r in got) == Counter(con.execute(mixing.OP8_SQL).fetchall())
    taken = Counter()
    for r in got:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - target) <= 256 for (_, target), n in taken.items())
    staged = Counter(r["source"] for r in mixing.mix_stage(spark, docs, "").select("source", F.explode(F.split(F.trim("text"), " "))).collect())
    assert sorted(staged.values()) == sorted(taken.values())
