"""Grids of tiles that lie together: the same results as from shuffled cells, without their shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import components as C
from tilewright.operators import grids as GR

TILES = "image_id long, width int, height int, x0 int, y0 int, gh int, gw int, seg array<double>, tile_cls double"


@pytest.fixture(scope="module")
def scored(spark):
    """Records, of which image 2 is listed twice, 3 has no tile and 4 is too small for a cell; their tiles, dealt."""
    rng = np.random.default_rng(5)
    sizes = {1: (30, 26), 2: (41, 300), 3: (17, 22), 4: (3, 50)}
    listed = [(i, *sizes[i]) for i in (1, 2, 2, 3, 4)]
    tiles = []
    for i, w, h in sorted(listed):
        seed = {(x, y): rng.integers(0, 64, 16).astype(float).tolist() for x in (0, 6, 18) for y in ((0, 2, 9) if h < 99 else range(0, 290, 7))}
        if i != 3:
            tiles += [(i, w, h, x, y, 4, 4, v, 0.5) for (x, y), v in seed.items()]
    records = spark.createDataFrame(listed, "image_id long, width int, height int")
    return records, spark.createDataFrame(tiles, TILES).coalesce(1)


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def shuffled(df):
    """Names of the columns that the plan moves."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_dense_grid_of_dealt_tiles(spark, scored):
    records, tiles = scored
    cells = GR.threshold_cells(GR.merge_tiles(tiles, records, 4, dealt=True), 36.0)
    want = rows_of(GR.dense_grid(cells, records, 4).select("image_id", "gy", "gx", "prob"))
    got = GR.dense_row_cells(GR.dense_rows(tiles, records, 4), 36.0)
    assert rows_of(got) == want and len(want) == 7 * 6 + 10 * 75 + 4 * 5
    # the rows of the tiles are not moved, only identifiers are and the rows of images without a tile
    plan = GR.dense_rows(tiles, records, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("MapInArrow") < plan.index("Aggregate")


@pytest.mark.parametrize("scale", [0, 2])
def test_bilinear_of_dealt_tiles(spark, scored, scale, monkeypatch):
    records, tiles = scored
    monkeypatch.setattr(GR, "_VALUES", 500)
    usable = records.where("width >= 4")
    out = ["gh * 2 as out_h", "gw * 2 as out_w"] if scale else ["height as out_h", "width as out_w"]
    sizes = usable.selectExpr("*", "cast(height div 4 as int) as gh", "cast(width div 4 as int) as gw").selectExpr("image_id", "gh", "gw", *out)
    old = GR.upsample_bilinear(GR.merge_rows(tiles, records, 4, dealt=True), sizes)
    want = {(r.image_id, r.y): r.vals for r in old.collect()}
    new = GR.upsample_tiles(tiles, usable, 4, scale)
    got = [r for r in new.where("image_id <> 4").collect()]
    assert {(r.image_id, r.y): r.vals for r in got} == want and len(got) == len(want)


def test_bilinear_spans_of_dealt_tiles(spark, scored):
    records, tiles = scored
    for threshold in (30.5, 0.0):
        want = rows_of(GR.row_spans_at(GR.upsample_tiles(tiles, records, 4, 2), threshold))
        assert rows_of(GR.upsample_tiles(tiles, records, 4, 2, threshold)) == want and want


def test_nearest_rectangles_with_sizes(spark, scored):
    """A record that is listed twice counts twice, as in a join with records."""
    records, tiles = scored
    cells = GR.merge_tiles(tiles, records, 4, dealt=True)
    sized = GR.merge_rows(tiles, records, 4, dealt=True, sizes=True).select("image_id", "gy", "x0", "sizes", F.posexplode("prob").alias("_i", "prob"))
    sized = sized.select("image_id", "gy", F.expr("x0 + _i as gx"), "prob", "sizes")
    old = GR.upsample_nearest(GR.threshold_cells(cells, 36.0), records, 4)
    rects = GR.nearest_rects(GR.threshold_cells(sized, 36.0), records, 4)
    assert rows_of(rects.select("image_id", F.explode(F.sequence("t", "b")).alias("y"), "xs", "xe")) == rows_of(old)
    assert not shuffled(rects)


def test_component_stats_of_dealt_runs(spark, scored):
    """Image 2 is taller than a band; its components go on over the edge."""
    records, tiles = scored
    for threshold, least in ((20.0, 1), (42.0, 6)):
        runs = GR.row_runs(GR.merge_rows(tiles, records, 4, dealt=True), threshold)
        want = rows_of(C.run_stats(C.component_id(C.label_runs(runs)), 4).withColumn("score", F.round("score", 9)))
        dealt = C.run_stats(C.component_id(C.label_runs(runs, dealt=True)), 4, dealt=True)
        assert rows_of(dealt.withColumn("score", F.round("score", 9))) == want and len(want) > least
        assert not shuffled(dealt)


def test_inference_report_from_runs(spark, scored):
    records, tiles = scored
    pos = GR.threshold_cells(GR.merge_tiles(tiles, records, 4, dealt=True), 36.0)
    polys = C.connected_components(pos).select("image_id", "comp_y", "comp_x").distinct()
    want = rows_of(GR.inference_report(records, GR.tile_cls_stats(tiles), GR.upsample_nearest(pos, records, 4), polys))
    runs = C.label_runs(GR.row_runs(GR.merge_rows(tiles, records, 4, dealt=True, sizes=True), 36.0), dealt=True)
    report = GR.inference_report(records, GR.tile_cls_stats(tiles), GR.nearest_rects(runs, records, 4), runs.where("gy = comp_y and xs = comp_x"))
    assert rows_of(report) == want and len(want) == 5


def test_only_tiles_of_accepted_images_are_made(spark, tmp_path):
    """The export of accepted images is the same from polygons of those images alone."""
    from tilewright.plans import fixtures as X
    from tilewright.plans import jobs as J

    spark.createDataFrame([(i,) for i in range(1, 9)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    log = spark.createDataFrame([(1, 3, "a"), (2, 5, "n"), (3, 6, "a"), (4, 6, "d"), (5, 77, "a"), (6, None, "a")], "seq long, image_id long, key string")
    accepted = J.accepted_images(log)
    ids = {r["image_id"] for r in accepted.collect()}
    tiles = rows_of(X.tile_preds(spark, str(tmp_path), accepted).drop("seg"))
    assert tiles == rows_of(X.tile_preds(spark, str(tmp_path)).drop("seg").where(F.col("image_id").isin(sorted(i for i in ids if i)))) and tiles
    point = "array<struct<x:double,y:double>>"
    polygons = spark.createDataFrame([(i, 0, 0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]) for i in range(1, 9)], f"image_id long, comp_y int, comp_x int, points {point}")
    records = X.records(spark, str(tmp_path)).withColumn("image_name", F.format_string("%d.png", "image_id"))
    whole = rows_of(J.curation_export(polygons, records, log, "car"))
    assert rows_of(J.curation_export(polygons.join(accepted, "image_id", "left_semi"), records, log, "car")) == whole and whole
