import math

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import labels as L
from tilewright.operators.tiling import tile_configs


def one(spark, col, **inputs):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in inputs.items()) or "x int"
    row = tuple(v for _, v in inputs.values()) or (0,)
    return spark.createDataFrame([row], schema).select(col.alias("v")).first()["v"]


P = "array<struct<x:double,y:double>>"


def pts(*xy):
    return (P, [tuple(map(float, p)) for p in xy])


def test_shape_to_points(spark):
    q = G.shape_to_points(F.col("t"), F.col("p"))
    assert [tuple(p) for p in one(spark, q, t=("string", "Rectangle"), p=pts((5, 7), (1, 2)))] == [(1, 2), (5, 2), (5, 7), (1, 7)]
    assert one(spark, q, t=("string", "rectangle"), p=pts((5, 7))) is None
    assert one(spark, q, t=("string", "polygon"), p=pts((5, 7), (1, 1))) is None
    assert len(one(spark, q, t=("string", None), p=pts((5, 7), (1, 1), (2, 9)))) == 3


@pytest.mark.parametrize("ring, area, centre", [
    (((0, 0), (4, 0), (4, 2), (0, 2)), 8.0, (2, 1)),
    (((0, 0), (0, 2), (4, 2), (4, 0)), 8.0, (2, 1)),
    (((0, 0), (2, 2), (4, 4)), 0.0, (2, 2)),
    (((0, 0), (6, 0)), 0.0, (3, 0)),
    ((), 0.0, (0, 0)),
    (((0, 0), (6, 0), (0, 3)), 9.0, (2, 1)),
])
def test_area_and_centroid(spark, ring, area, centre):
    assert one(spark, G.polygon_area(F.col("p")), p=pts(*ring)) == area
    assert tuple(one(spark, G.polygon_centroid(F.col("p")), p=pts(*ring))) == pytest.approx(centre)


def test_rect_prompt(spark):
    q = G.rect_prompt(F.col("p"))
    got = one(spark, q, p=pts((9, 8), (1, 2)))
    assert tuple(got["box"]) == (1, 2, 9, 8) and tuple(got["point"]) == (5, 5)
    assert one(spark, q, p=pts((1, 2), (1, 9))) is None and one(spark, q, p=pts((1, 2))) is None


def test_box_iou(spark):
    def iou(a, b):
        box = "struct<x0:double,y0:double,x1:double,y1:double>"
        return one(spark, G.box_iou(F.col("a"), F.col("b")), a=(box, tuple(map(float, a))), b=(box, tuple(map(float, b))))
    assert iou((0, 0, 2, 2), (0, 0, 2, 2)) == 1.0
    assert iou((0, 0, 2, 2), (2, 0, 4, 2)) == 0.0
    assert iou((0, 0, 0.5, 0.5), (0, 0, 0.5, 0.5)) == pytest.approx(0.25 / 1.75)  # areas below 1 count as 1


def test_half_even_and_windows(spark):
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(21.0).alias("x1"), F.lit(5.0).alias("y1"))
    got = one(spark, G.object_crop_window(box, 1.0))
    assert (got["x0"], got["y0"], got["side"]) == (0, -8, 21)
    thin = one(spark, G.object_tile_window(box, F.lit(1), F.lit(100), 8, 1.0))
    assert thin is None
    pad = one(spark, G.crop_pad_rect(F.lit(-3), F.lit(4), F.lit(10), F.lit(5), F.lit(20)))
    assert tuple(pad) == (0, 4, 5, 14, 3, 0)


def test_tile_configs(spark):
    def column(scales):
        return [tuple(c) for c in one(spark, G.tile_configs(224, 112, F.col("s")), s=("string", scales))]
    for scales in ("1.0,1.5", " 1.0 ,, 1.0", "", "0.01,2"):
        assert column(scales) == tile_configs(224, 112, scales)
    assert tile_configs(224, 112, "0.01") == [(14, 1)]


def test_labels(spark):
    assert one(spark, L.normalize_label(F.col("s")), s=("string", "\t VEHICLE\n")) == "vehicle"
    assert one(spark, L.label_or_unknown(F.col("s")), s=("string", "  ")) == "unknown"
    tags = ("array<string>", ["FP", " Vehicle "])
    assert one(spark, L.choose_label_from_tags(F.col("t"), ["vehicle", "fp"]), t=tags) == "vehicle"
    assert one(spark, L.choose_label_from_tags(F.col("t"), ["fp", "vehicle"]), t=tags) == "fp"
    assert one(spark, L.choose_label_from_tags(F.col("t"), ["car"]), t=tags) is None
    assert one(spark, L.choose_label_from_tags(F.col("t"), ["car"]), t=("array<string>", None)) is None
    flags = one(spark, L.flags_with_source(F.col("f"), "new"), f=("map<string,string>", {"source": "old", "a": "b"}))
    assert flags == {"source": "new", "a": "b"}
    assert one(spark, L.flags_with_source(F.col("f"), "new"), f=("map<string,string>", None)) == {"source": "new"}


def test_names(spark):
    path = ("string", "/data/a.b/My.Photo.PNG")
    assert one(spark, L.file_stem(F.col("p")), p=path) == "My.Photo"
    assert one(spark, L.file_ext(F.col("p")), p=path) == ".png"
    assert one(spark, L.frame_name(F.lit("v"), F.lit(7))) == "v_000007"
    assert one(spark, L.object_name(F.lit("v"), F.lit(12345))) == "v__obj12345"
    assert one(spark, L.screen_name(F.lit(1700000000123), F.lit(5))) == "screen_1700000000123_000005"


def test_sigmoid_and_buckets(spark):
    assert one(spark, G.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, G.sigmoid(F.lit(-800.0))) == 0.0 and math.isclose(one(spark, G.sigmoid(F.lit(800.0))), 1.0)
    for area, want in ((1023.9, "small"), (1024.0, "medium"), (9215.9, "medium"), (9216.0, "large")):
        assert one(spark, G.size_bucket(F.lit(area))) == want
