"""Expressions on single shapes, labels, boxes and crops."""

from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import file_stem, hashed_image_name, normalize_label, object_name
from tilewright.operators import selection as S
from tilewright.plans import fixtures as X

QUERIES, ORACLES = {}, {}
R = 6


def _r(col, name):
    return F.round(col, R).alias(name)


def polygon_geometry(spark, d):
    s = X.shapes(spark, d).withColumn("o", G.shape_to_points(F.col("shape_type"), F.col("points")))
    s = s.select("image_id", "shape_idx", G.outline_stats(F.col("o")).alias("s"))
    c, m = G.stats_centroid(F.col("s")), G.stats_mean(F.col("s"))
    return s.select("image_id", "shape_idx", F.col("s.n").cast("bigint").alias("n"), "s.x0", "s.y0", "s.x1", "s.y1",
                    _r(G.stats_area(F.col("s")), "area"), _r(c["x"], "cx"), _r(c["y"], "cy"), _r(m["x"], "mx"), _r(m["y"], "my"))


QUERIES["polygon_geometry"] = polygon_geometry
ORACLES["polygon_geometry"] = X.with_sql("boxes") + """
select image_id, shape_idx, 4::bigint as n, bx as x0, by_ as y0, bx + bw as x1, by_ + bh as y1,
  round(case when shape_type = 'rectangle' then bw * bh else bw * bh / 2 end, 6) as area,
  round(bx + bw / 2, 6) as cx, round(by_ + bh / 2, 6) as cy, round(bx + bw / 2, 6) as mx, round(by_ + bh / 2, 6) as my
from boxes"""


def objects(spark, d):
    return S.objects_from_shapes(X.shapes(spark, d), "Vehicle", "fp")


def object_table(spark, d):
    o = objects(spark, d)
    return o.select("image_id", "shape_idx", "label_cf", "is_fp", "shape_type", "x0", "y0", "x1", "y1", _r(F.col("cx"), "cx"),
                    _r(F.col("cy"), "cy"), _r(F.col("area"), "area"))


QUERIES["object_table"] = object_table
ORACLES["object_table"] = X.with_sql("boxes", "objects") + """
select image_id, shape_idx, label_cf, is_fp, shape_type, x0, y0, x1, y1, round(cx, 6) as cx, round(cy, 6) as cy,
  round(area, 6) as area from objects"""


def shape_prompts(spark, d):
    s = X.shapes(spark, d).withColumn("st", G.outline_stats(F.col("points")))
    box = G.rect_prompt(F.col("points"))["box"]
    return s.select("image_id", "shape_idx", F.when(G.is_rectangle(F.col("shape_type")), box).alias("b"),
                    G.shape_prompt_point(F.col("shape_type"), F.col("points"), F.col("st")).alias("p")).select(
        "image_id", "shape_idx", "b.x0", "b.y0", "b.x1", "b.y1", _r(F.col("p.x"), "px"), _r(F.col("p.y"), "py"))


QUERIES["shape_prompts"] = shape_prompts
ORACLES["shape_prompts"] = X.with_sql("boxes") + """
select image_id, shape_idx, case when r then bx end as x0, case when r then by_ end as y0,
  case when r then bx + bw end as x1, case when r then by_ + bh end as y1,
  round(bx + bw / 2, 6) as px, round(by_ + bh / 2, 6) as py
from (select *, shape_type = 'rectangle' as r from boxes)"""


def box_iou(spark, d):
    o = objects(spark, d).select("image_id", "shape_idx", "x0", "y0", "x1", "y1")
    dx, dy = F.pmod(F.col("shape_idx"), F.lit(41)) - 20, F.pmod(F.col("shape_idx"), F.lit(23)) - 11
    a = F.struct("x0", "y0", "x1", "y1")
    b = F.struct((F.col("x0") + dx).alias("x0"), (F.col("y0") + dy).alias("y0"), (F.col("x1") + dx).alias("x1"),
                 (F.col("y1") + dy).alias("y1"))
    return o.select("image_id", "shape_idx", _r(G.box_iou(a, b), "iou"))


QUERIES["box_iou"] = box_iou
ORACLES["box_iou"] = X.with_sql("boxes") + """,
moved as (select image_id, shape_idx, bw, bh, abs(shape_idx % 41 - 20) as dx, abs(shape_idx % 23 - 11) as dy from boxes),
parts as (select *, greatest(bw - dx, 0) * greatest(bh - dy, 0) as inter, greatest(1, bw * bh) as area from moved)
select image_id, shape_idx, round(case when inter <= 0 then 0 else inter / (2 * area - inter) end, 6) as iou from parts"""


def object_crops(spark, d):
    o = objects(spark, d).join(X.records(spark, d), "image_id")
    box = F.struct("x0", "y0", "x1", "y1")
    w, h = F.col("width"), F.col("height")
    o = o.withColumn("o", F.when(F.col("shape_type") == "rectangle", F.array(
        G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y0")), G.point(F.col("x1"), F.col("y1")),
        G.point(F.col("x0"), F.col("y1")))).otherwise(F.col("points")))
    o = o.withColumns({"c": G.object_crop_window(box, 1.6), "t": G.object_tile_window(box, w, h, 96, 2.0),
                       "z": G.zoom_candidate_window(box, w, h, 224)})
    o = o.withColumns({"p": G.crop_pad_rect(F.col("c.x0"), F.col("c.y0"), F.col("c.side"), w, h),
                       "l": G.outline_stats(G.points_in_crop(F.col("o"), F.col("c"), 224))})
    o = o.withColumn("n", G.normalized_box(F.col("l"), F.lit(224), F.lit(224)))
    return o.select(
        "image_id", "shape_idx", F.col("c.x0").alias("crop_x0"), F.col("c.y0").alias("crop_y0"), F.col("c.side").alias("side"),
        "p.sx0", "p.sy0", "p.sx1", "p.sy1", "p.ox", "p.oy", F.col("t.x0").alias("tx0"), F.col("t.y0").alias("ty0"),
        F.col("t.x1").alias("tx1"), F.col("t.y1").alias("ty1"), "z.cx0", "z.cy0", "z.cx1", "z.cy1",
        _r(F.col("z.zx0"), "zx0"), _r(F.col("z.zy0"), "zy0"), _r(F.col("z.zx1"), "zx1"), _r(F.col("z.zy1"), "zy1"),
        _r(F.col("n.x"), "nx"), _r(F.col("n.y"), "ny"), _r(F.col("n.w"), "nw"), _r(F.col("n.h"), "nh"))


QUERIES["object_crops"] = object_crops
ORACLES["object_crops"] = X.with_sql("records", "boxes", "objects") + """,
sized as (select o.*, r.width as w, r.height as h, greatest(1, x1 - x0) as bw, greatest(1, y1 - y0) as bh
  from objects o join records r using (image_id)),
sides as (select *, greatest(16, ceil(greatest(bw, bh) * 1.6::double))::int as side, greatest(96, ceil(greatest(bw, bh) * 2.0::double))::int as ts from sized),
crops as (select *, round_even(0.5 * (x0 + x1) - 0.5 * side, 0)::int as cx_, round_even(0.5 * (y0 + y1) - 0.5 * side, 0)::int as cy_,
  greatest(0, least(round_even(0.5 * (x0 + x1) - ts / 2.0, 0)::int, w - ts)) as tx0,
  greatest(0, least(round_even(0.5 * (y0 + y1) - ts / 2.0, 0)::int, h - ts)) as ty0,
  greatest(0, floor(x0 - greatest(2, bw * 0.2::double)))::int as cx0, greatest(0, floor(y0 - greatest(2, bh * 0.2::double)))::int as cy0,
  least(w, ceil(x1 + greatest(2, bw * 0.2::double)))::int as cx1, least(h, ceil(y1 + greatest(2, bh * 0.2::double)))::int as cy1 from sides),
local as (select *, greatest(0, least(223, (x0 - cx_) * (224.0::double / side))) as ax, greatest(0, least(223, (y0 - cy_) * (224.0::double / side))) as ay,
  greatest(0, least(223, (x1 - cx_) * (224.0::double / side))) as bx, greatest(0, least(223, (y1 - cy_) * (224.0::double / side))) as by_,
  greatest(0, least(223, (x0 - cx0) * (224.0::double / (cx1 - cx0)))) as zx0, greatest(0, least(223, (y0 - cy0) * (224.0::double / (cy1 - cy0)))) as zy0 from crops)
select image_id, shape_idx, cx_ as crop_x0, cy_ as crop_y0, side, greatest(0, cx_) as sx0, greatest(0, cy_) as sy0,
  least(w, cx_ + side) as sx1, least(h, cy_ + side) as sy1, greatest(0, cx_) - cx_ as ox, greatest(0, cy_) - cy_ as oy,
  tx0, ty0, least(w, tx0 + ts) as tx1, least(h, ty0 + ts) as ty1, cx0, cy0, cx1, cy1,
  round(zx0, 6) as zx0, round(zy0, 6) as zy0,
  round(greatest(zx0 + 1, least(224, (x1 - cx0) * (224.0::double / (cx1 - cx0)))), 6) as zx1,
  round(greatest(zy0 + 1, least(224, (y1 - cy0) * (224.0::double / (cy1 - cy0)))), 6) as zy1,
  round(ax / 224, 6) as nx, round(ay / 224, 6) as ny, round(least(224, greatest(1, bx - ax)) / 224, 6) as nw,
  round(least(224, greatest(1, by_ - ay)) / 224, 6) as nh
from local"""


def size_buckets(spark, d):
    return (objects(spark, d).groupBy(G.size_bucket(F.col("area")).alias("bucket"), "label_cf")
            .agg(F.count(F.lit(1)).alias("n"), _r(F.sum("area"), "total_area")))


QUERIES["size_buckets"] = size_buckets
ORACLES["size_buckets"] = X.with_sql("boxes", "objects") + """
select case when area < 1024 then 'small' when area < 9216 then 'medium' else 'large' end as bucket, label_cf,
  count(*) as n, round(sum(area), 6) as total_area from objects group by 1, 2"""


def object_names(spark, d):
    i = X.images(spark, d)
    return i.select("path", file_stem(F.col("path")).alias("stem"), hashed_image_name(F.col("path")).alias("hashed"),
                    object_name(file_stem(F.col("path")), F.length("path")).alias("object_name"))


QUERIES["output_names"] = object_names
ORACLES["output_names"] = X.with_sql("stems") + """
select '/data/' || stem || ext as path, stem, stem || '__' || substr(sha1('/data/' || stem || ext), 1, 8) || lower(ext) as hashed,
  stem || '__obj' || lpad(cast(length('/data/' || stem || ext) as varchar), 4, '0') as object_name from imgs"""


def filtered_labels(spark, d):
    kept = S.filter_labels(X.shapes(spark, d), ["VEHICLE "])
    return kept.groupBy("label", normalize_label(F.col("label")).alias("label_cf")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["filter_labels"] = filtered_labels
ORACLES["filter_labels"] = X.with_sql("boxes") + """
select label, lower(trim(label)) as label_cf, count(*) as n from boxes where lower(trim(label)) = 'vehicle' group by 1, 2"""
