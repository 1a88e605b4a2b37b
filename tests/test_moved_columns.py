"""What queries evaluate and move, read off their plans: a few rows can't show it otherwise."""

import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import raster as RA
from tilewright.plans import fixtures as X
from tilewright.plans.registry import grids, objects, profiling, tiling
from tilewright.plans.registry.shapes import objects as found_objects
from tilewright.sources.writers import to_labelme

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_span_totals_are_sums_of_spans(spark):
    rng = np.random.default_rng(5)
    rings = [[(float(a), float(b)) for a, b in rng.uniform(-5, 45, (n, 2))] for n in (3, 4, 7, 12) * 20] + [[(1.0, 1.0), (2.0, 2.0)]]
    df = spark.createDataFrame([(i, r, 40, 30) for i, r in enumerate(rings)], "id long, points array<struct<x:double,y:double>>, width int, height int")
    got = RA.span_totals(df, ["id"], {"n": lambda y, xs, xe: xe - xs + 1, "m": lambda y, xs, xe: y * xs})
    want = RA.spans(df, ["id"]).groupBy("id").agg(F.sum(F.col("xe") - F.col("xs") + 1).alias("n"), F.sum(F.col("y") * F.col("xs")).alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Aggregate" not in optimized(tiling.QUERIES["raster_cells"](spark, SF))


def test_crossings_of_self_crossing_rings_pair_up_by_column():
    xs, ys = np.array([0.0, 20.0, 0.0, 20.0, 5.0]), np.array([0.0, 20.0, 20.0, 0.0, 30.0])
    owner, row, left, right = RA.polygon_spans(np.array([0, 5]), xs, ys, np.array([40]), np.array([40]))
    for y in range(30):
        cuts = sorted(xs[i] + (y + 0.5 - ys[i]) * (xs[(i + 1) % 5] - xs[i]) / (ys[(i + 1) % 5] - ys[i]) for i in range(5)
                      if (ys[i] <= y + 0.5) != (ys[(i + 1) % 5] <= y + 0.5))
        want = [(int(np.ceil(a - 0.5)), int(np.ceil(b - 0.5)) - 1) for a, b in zip(cuts[::2], cuts[1::2])]
        assert sorted(zip(left[row == y], right[row == y])) == [w for w in want if w[0] <= w[1]]


def test_quantiles_evaluate_objects_once(spark):
    from tilewright.operators import profile as P

    samples = P.ratio_samples(X.records(spark, SF), found_objects(spark, SF), ["label_cf"])
    assert samples.columns == ["image_id", "shape_idx", "label_cf", "ratio"]
    assert optimized(samples).count("Join") == 1


def test_boxes_of_objects_are_evaluated_once_and_sums_only_when_asked_for(spark):
    box = found_objects(spark, SF).select("image_id", "x0", "y0", "x1", "y1").where("x1 > x0 and y1 > y0")
    plan = optimized(box)
    assert plan.count("array_max") == 2 and "aggregate(" not in plan
    assert optimized(objects.overlap_rejects(spark, SF)).count("array_max") == 2
    assert "aggregate(" not in optimized(grids.zoom_scores(spark, SF))


def test_shapes_move_once_into_documents(spark):
    records = X.records(spark, SF).withColumn("image_name", F.lit("a.png"))
    shapes = X.shapes(spark, SF).select("image_id", "shape_idx", F.struct("label", "points").alias("shape"))
    plan = to_labelme(records, shapes, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "pinned" not in plan.replace("Exchange", "")


def test_counts_of_samples_move_no_outlines(spark):
    c = objects.classified(spark, SF).select("reason", "source_image_path", "_idx", "out_label", *objects.ORDER)
    assert "_fallback" not in optimized(c) and "AS outline" not in optimized(c)
