import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import ranking as R
from tilewright.operators import selection as S
from tilewright.operators.ranking import exact_quantiles, number_rows, seeded_rank, seeded_sample


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and, within it, one value."""
    rows = [(0, i, 5) for i in range(3000)] + [(1 + i % 50, i, (i * 37) % 101) for i in range(6000)]
    return spark.createDataFrame(rows, "k int, id int, v int").repartition(8), rows


def test_number_rows(skewed):
    df, rows = skewed
    got = {(r["k"], r["id"]): (r["rank"], r["total"]) for r in number_rows(df, ["k"], [F.col("v").desc(), "id"], total="total").collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        assert [got[(key, r[1])] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]


def test_running_sum(skewed):
    df, rows = skewed
    got = {(r["k"], r["id"]): r["s"] for r in number_rows(df, [], ["k", "v", "id"], "s", weight="v").collect()}
    total = 0
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        total += r[2]
        assert got[(r[0], r[1])] == total


def test_quantiles(skewed):
    df, rows = skewed
    got = {r["k"]: r for r in exact_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}, ["k"]).collect()}
    for key in {r[0] for r in rows}:
        want = np.quantile([r[2] for r in rows if r[0] == key], [0, 0.5, 0.9, 1.0])
        assert [got[key][c] for c in "abcd"] == pytest.approx(list(want))


def test_seeded_order_is_a_permutation(skewed):
    df, rows = skewed
    ranks = [r["rank"] for r in seeded_rank(df, [], 1, ["k", "id"]).select("rank").collect()]
    assert sorted(ranks) == list(range(1, len(rows) + 1))
    first = seeded_sample(df, 20, 1, ["k", "id"]).collect()
    again = seeded_sample(df.repartition(3), 20, 1, ["k", "id"]).collect()
    assert [tuple(r) for r in first] == [tuple(r) for r in again]


def test_smoothed_rate(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, float(x)) for k, n in ((0, 3000), (1, 1), (2, 513), (3, 1100)) for i, x in enumerate(rng.uniform(1, 60, n))]
    rows = [(k, i, 0.0 if k == 3 and i < 600 else x) for k, i, x in rows] + [(4, 0, 0.0), (4, 1, 10.0), (4, 2, 10.0), (5, 0, 0.0)]
    got = {(r["k"], r["i"]): r["smoothed"] for r in
           S.smoothed_rate(spark.createDataFrame(rows, "k int, i bigint, x double"), "k", "i", "x").collect()}
    state = {}
    for k, i, x in rows:
        state[k] = x if state.get(k, 0.0) <= 0 else 0.9 * state[k] + 0.1 * x
        assert got[(k, i)] == pytest.approx(state[k], rel=1e-12)


def test_ratio_fallback(spark):
    none = spark.createDataFrame([(0.9,)], "ratio double")
    assert sorted(r["ratio"] for r in S.size_ratio_filter(none, 0.0, 0.1).collect()) == [0.001, 0.002, 0.003, 0.005, 0.008]
    some = spark.createDataFrame([(0.9,), (0.05,)], "ratio double")
    assert [r["ratio"] for r in S.size_ratio_filter(some, 0.0, 0.1).collect()] == [0.05]


def test_valid_records_and_labels(spark):
    rec = spark.createDataFrame([("a", 0, 0), ("b", 5, 5), ("c", None, None)], "image_id string, width int, height int")
    real = spark.createDataFrame([("a", 8, 6)], "image_id string, width int, height int")
    assert {r["image_id"]: r["width"] for r in S.valid_records(rec, real).collect()} == {"a": 8, "b": 5}
    assert S.valid_records(rec).count() == 1
    shapes = spark.createDataFrame([("a", 0, " FP ", "polygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])],
                                   "image_id string, shape_idx int, label string, shape_type string, points array<struct<x:double,y:double>>")
    assert not S.objects_from_shapes(shapes, "fp", "fp").first()["is_fp"]
    assert S.objects_from_shapes(shapes, "vehicle", "fp").first()["is_fp"]
    assert S.objects_from_shapes(shapes, "vehicle").count() == 0


def test_decisions(spark):
    log = spark.createDataFrame([(1, 0, "a"), (2, 0, "n"), (3, 0, "D"), (4, 1, "d"), (5, 1, "A"), (6, 2, "p")], "seq int, image_idx int, key string")
    got = {r["image_idx"]: (r["state"], r["exported"]) for r in S.last_decisions(log).collect()}
    assert got == {0: ("reject", True), 1: ("accept", True)}


def test_null_keys_keep_their_rows(spark):
    rows = [(None, 1), (None, 2), ("a", 1), ("a", 2)]
    got = number_rows(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"]).collect()
    assert sorted((r["k"] or "", r["v"], r["rank"]) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 1, 1), ("a", 2, 2)]


def test_draws_reach_beyond_32_bits(spark):
    from tilewright.functions.draws import draw_int, seeded_digest
    got = spark.range(200).select(draw_int(seeded_digest(1, F.col("id")), F.lit(1 << 50)).alias("d")).collect()
    assert max(r["d"] for r in got) > 1 << 48 and min(r["d"] for r in got) >= 0


@pytest.mark.parametrize("few, digits", [(20_000, 4), (5, 1), (0, 1)])
def test_first_by_count_equals_first_by_rank(spark, monkeypatch, few, digits):
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "DIGITS", digits)
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("kind"))
    quotas = {"a": 17, "b": 1111, "c": 5000, "none": 3}
    got = R.seeded_first(df, "kind", quotas, 7, ["id"]).collect()
    ranked = R.seeded_rank(df, ["kind"], 7, ["id"]).collect()
    want = {(r["id"], r["kind"]) for r in ranked if r["rank"] <= quotas[r["kind"]]}
    assert {tuple(r) for r in got} == want and len(got) == 17 + 1111 + 300
    assert R.seeded_first(df, "kind", {"a": 0}, 7, ["id"]).count() == 0


def test_small_keys_are_numbered_in_one_move_and_large_ones_in_chunks(spark, monkeypatch):
    from tilewright.operators import ranking

    monkeypatch.setattr(ranking, "FEW", 50)
    rows = [(k, (i * 37) % 1009) for k, n in ((1, 20), (2, 300), (None, 80), (None, 0), (4, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = [(r["k"], r["v"], r["rank"], r["n"]) for r in ranking.number_within(df, ["k"], ["v"], total="n").collect()]
    want = []
    for k in (1, 2, None, 4):
        values = sorted(v for key, v in rows if key == k)
        want += [(k, v, i + 1, len(values)) for i, v in enumerate(values)]
    assert sorted(got, key=str) == sorted(want, key=str)
    few = ranking.number_within(df.where("k = 1"), ["k"], ["v"])
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
