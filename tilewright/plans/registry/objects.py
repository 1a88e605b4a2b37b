"""Object samples, embeddings, donors, export and replacement of shapes."""

from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import choose_label_from_tags
from tilewright.operators import embeddings as V
from tilewright.operators import export as EX
from tilewright.operators import pasting as PA
from tilewright.operators import profile as P
from tilewright.operators import selection as S
from tilewright.plans import fixtures as X
from tilewright.plans import jobs as J
from tilewright.plans.registry.evaluation import det_boxes
from tilewright.plans.registry.shapes import objects

QUERIES, ORACLES = {}, {}

QUERIES["donor_pool"] = lambda s, d: PA.build_donor_pool(X.shapes(s, d), X.records(s, d), 400.0).select(
    "image_id", "shape_idx", "area", "bbox_h", "bbox_w")
ORACLES["donor_pool"] = X.with_sql("records", "boxes", "spans") + """,
a as (select image_id, shape_idx, sum(xe - xs + 1)::double as area from spans group by 1, 2)
select image_id, shape_idx, area, bh::int as bbox_h, bw::int as bbox_w from a join boxes using (image_id, shape_idx) where area >= 400
qualify row_number() over (partition by image_id order by area desc, shape_idx) = 1"""


def overlap_rejects(s, d):
    cand = det_boxes(s, d).select("image_id", "det_id", "x0", "y0", "x1", "y1")
    hit = PA.overlapping(cand, objects(s, d).where(~F.col("is_fp")), 0.25, ["det_id"])
    return cand.join(hit, ["image_id", "det_id"], "left_anti").select("image_id", "det_id")


QUERIES["overlap_rejects"] = overlap_rejects
ORACLES["overlap_rejects"] = X.with_sql("records", "boxes", "objects") + """,
c as (select image_id, shape_idx as det_id, bx + shape_idx % 41 - 20 as x0, by_ + shape_idx % 23 - 11 as y0, bx + shape_idx % 41 - 20 + bw as x1,
  by_ + shape_idx % 23 - 11 + bh as y1 from boxes),
p as (select c.image_id, det_id, greatest(0, least(c.x1, o.x1) - greatest(c.x0, o.x0)) * greatest(0, least(c.y1, o.y1) - greatest(c.y0, o.y0)) as i,
  greatest(1, (c.x1 - c.x0) * (c.y1 - c.y0)) + greatest(1, (o.x1 - o.x0) * (o.y1 - o.y0)) as t from c join objects o using (image_id) where not is_fp)
select image_id, det_id from c where not exists (select 1 from p where p.image_id = c.image_id and p.det_id = c.det_id and i > 0 and i / (t - i) > 0.25)"""


def paste_plan(s, d):
    # objects are evaluated once; what is read of them again and again is narrow
    rec = X.records(s, d)
    obj = J.pin(objects(s, d).where(~F.col("is_fp")).select("image_id", "shape_idx", "x0", "y0", "x1", "y1", "area"))
    donors = J.pin(PA.build_donor_pool(X.shapes(s, d), rec, 400.0))
    ratios = S.size_ratio_filter(P.ratio_samples(rec, obj), 0.001, 0.02)
    return PA.plan_pastes(rec, obj, donors, ratios, PA.PasteRules(min_pastes=1, max_pastes=3, tries=12))


QUERIES["paste_plan"] = paste_plan  # sequential acceptance; checked against brute force in the tests


def paired(s, d):
    return X.records(s, d).selectExpr(
        "image_id", "width", "height", "concat('/data/img_', lpad(cast(image_id as string), 10, '0'), '.png') as image_path",
        "concat('/data/img_', lpad(cast(image_id as string), 10, '0'), '.json') as json_path")


def object_samples(s, d):
    o = J.build_object_samples(paired(s, d), X.shapes(s, d).withColumn("shape_idx", F.pmod("shape_idx", F.lit(100000)))
                               .where(F.col("label") != ""), ["vehicle"])
    return o.select("image_id", "shape_idx", "source_image_path", "source_json_path", "source_label", "crop_name",
                    F.round("area_ratio", 8).alias("area_ratio"), "crop_x0", "crop_y0", "crop_side")


QUERIES["object_samples"] = object_samples
ORACLES["object_samples"] = X.with_sql("records", "boxes", "objects") + """,
o as (select o.*, trim(b.label) as lab, width, height, greatest(16, ceil(greatest(1, o.x1 - o.x0, o.y1 - o.y0) * 1.6::double))::int as side
  from objects o join boxes b using (image_id, shape_idx) join records using (image_id) where label_cf = 'vehicle')
select image_id, shape_idx % 100000 as shape_idx, '/data/img_' || lpad(cast(image_id as varchar), 10, '0') || '.png' as source_image_path,
  '/data/img_' || lpad(cast(image_id as varchar), 10, '0') || '.json' as source_json_path, lab as source_label,
  'img_' || lpad(cast(image_id as varchar), 10, '0') || '__obj' || case when shape_idx % 100000 < 10000 then lpad(cast(shape_idx % 100000 as varchar), 4, '0') else cast(shape_idx % 100000 as varchar) end || '.jpg' as crop_name,
  round(area / (width * height), 8) as area_ratio, round_even(0.5 * (x0 + x1) - 0.5 * side, 0)::int as crop_x0,
  round_even(0.5 * (y0 + y1) - 0.5 * side, 0)::int as crop_y0, side as crop_side from o"""


def knn(s, d):
    v = X.table(s, d, "embeddings")
    return V.knn_graph(v, 10).select(F.col("id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), "neighbor",
                                     F.round(F.col("distance"), 4).alias("distance"))


QUERIES["knn_graph"] = knn
ORACLES["knn_graph"] = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as e from v),
p as (select a.vec_id, b.vec_id as neighbor, 1 - list_inner_product(a.e, b.e) as dist from n a join n b on a.vec_id <> b.vec_id)
select vec_id, row_number() over (partition by vec_id order by dist, neighbor) as "rank", neighbor, round(dist, 4) as distance from p
qualify "rank" <= 10"""

QUERIES["kmeans"] = lambda s, d: V.cluster_objects(V.project_2d(X.table(s, d, "embeddings")), 12).select(
    "vec_id", "xy", "cluster")


def samples(s, d):
    """Tagged samples: index from the line number, tags from the flags, no outline on polygons."""
    b = X.table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(round(l_quantity) as bigint) as q",
        "cast(round(l_extendedprice * 100) as bigint) as p", "l_returnflag", "l_linestatus")
    path = "concat('/data/img_', lpad(cast(l_orderkey as string), 10, '0'), {0})"
    tags = ("case when l_returnflag = 'A' then array('Vehicle') when l_returnflag = 'N' and l_linestatus = 'F' then array('fp', ' vehicle') "
            "when l_returnflag = 'N' then array('FP') when l_linestatus = 'F' then array('other') else array() end")
    ext = "case when l_returnflag = 'A' then '.png' else '.jpg' end"
    pts = F.when(F.col("l_linestatus") == "F", F.array(
        G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(9.0), F.lit(0.0)), G.point(F.lit(9.0), F.lit(9.0))))
    return b.select(F.expr(path.format(ext)).alias("source_image_path"), F.expr(path.format("'.json'")).alias("source_json_path"),
                    F.expr("cast(l_linenumber % 7 - case when l_partkey % 13 = 0 then 1 else 0 end as bigint)").alias("source_obj_idx"),
                    F.expr(tags).cast("array<string>").alias("tags"), pts.alias("source_points"),
                    F.expr("l_partkey * 1000 + l_suppkey").alias("o1"), F.col("q").alias("o2"), F.col("p").alias("o3"))


def doc_shapes(s, d):
    """Shapes of the source documents: one per (order, line number), the first by key."""
    b = X.shapes(s, d, ("l_linenumber",))
    first = b.groupBy("image_id", "l_linenumber").agg(F.min_by(F.struct("shape_type", "points"), "shape_idx").alias("f"))
    return first.select(F.expr("concat('/data/img_', lpad(cast(image_id as string), 10, '0'), '.json')").alias("json_path"),
                        (F.col("l_linenumber") - 1).alias("shape_idx"), "f.shape_type", "f.points")


ORDER = ("o1", "o2", "o3")


def classified(s, d):
    return EX.classify_samples(samples(s, d), X.images(s, d), doc_shapes(s, d), ["vehicle", "fp"])


_SAMPLES = """
with smp as (select '/data/img_' || lpad(cast(l_orderkey as varchar), 10, '0') as base, l_orderkey,
  base || case when l_returnflag = 'A' then '.png' else '.jpg' end as img, l_linenumber % 7 - case when l_partkey % 13 = 0 then 1 else 0 end as idx,
  case when l_returnflag = 'A' then 'vehicle' when l_returnflag = 'N' and l_linestatus = 'F' then 'vehicle' when l_returnflag = 'N' then 'fp' end as lab,
  l_linestatus = 'F' as own, l_partkey * 1000 + l_suppkey as o1, round(l_quantity)::bigint as o2, round(l_extendedprice * 100)::bigint as o3 from lineitem),
files as (select distinct '/data/img_' || lpad(cast(l_orderkey as varchar), 10, '0') || case l_returnflag when 'A' then '.png' when 'N' then '.jpg' else '.JPEG' end as img from lineitem),
sh as (select distinct l_orderkey, l_linenumber - 1 as idx from lineitem),
cl as (select smp.*, case when lab is null then 'unlabeled' when smp.idx < 0 or files.img is null or not (own or sh.idx is not null) then 'invalid' else 'valid' end as reason
  from smp left join files using (img) left join sh on sh.l_orderkey = smp.l_orderkey and sh.idx = smp.idx),
sel as (select * from cl where reason = 'valid' qualify row_number() over (partition by img, idx, lab order by o1, o2, o3) = 1)"""

QUERIES["export_tagged"] = lambda s, d: EX.selected_objects(classified(s, d), ORDER).select(
    "source_image_path", "source_obj_idx", "out_label", F.size("outline").cast("bigint").alias("n_points"), "o1")
ORACLES["export_tagged"] = _SAMPLES + """
select img as source_image_path, idx::bigint as source_obj_idx, lab as out_label, case when own then 3 else 4 end::bigint as n_points, o1 from sel"""


def export_counts(s, d):
    c = J.pin(classified(s, d).select("reason", "source_image_path", "_idx", "out_label", *ORDER))
    return EX.export_counts(c, EX.selected_objects(c, ORDER))


QUERIES["export_counts"] = export_counts
ORACLES["export_counts"] = _SAMPLES + """
select count(*) filter (reason = 'unlabeled') as skipped_unlabeled, count(*) filter (reason = 'invalid') as skipped_invalid,
  (select count(*) from sel) as exported_shapes, (select count(distinct img) from sel) as exported_images,
  count(*) filter (reason = 'valid') - (select count(*) from sel) as duplicates from cl"""

QUERIES["labels_from_tags"] = lambda s, d: samples(s, d).groupBy(
    choose_label_from_tags(F.col("tags"), ["fp", "Vehicle"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))
ORACLES["labels_from_tags"] = """
select case when l_returnflag = 'N' then 'fp' when l_returnflag = 'A' then 'Vehicle' end as label, count(*) as n from lineitem group by 1"""


def replaced(s, d):
    shapes = X.shapes(s, d).withColumns({
        "group_id": F.lit(None).cast("bigint"), "flags": F.create_map(F.lit("source"), F.lit("hand"), F.lit("k"), F.col("label"))})
    k = F.pmod("shape_idx", F.lit(3)).cast("int")
    new = shapes.where(F.col("shape_type") == "rectangle").select(
        "image_id", "shape_idx", F.explode(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))).alias("poly_idx"),
        F.array(G.point(F.lit(1.0), F.lit(1.0)), G.point(F.lit(5.0), F.lit(1.0)), G.point(F.lit(5.0), F.lit(7.0))).alias("points"))
    return EX.replace_shapes(shapes, new, "box_to_poly")


QUERIES["replace_shapes"] = lambda s, d: replaced(s, d).select(
    "image_id", "shape_idx", "poly_idx", "label", "shape_type", F.size("points").cast("bigint").alias("n"),
    F.col("flags")["source"].alias("source"), F.col("flags")["k"].alias("k"))
ORACLES["replace_shapes"] = X.with_sql("boxes") + """
select image_id, shape_idx, coalesce(p.i, 0)::int as poly_idx, label, case when p.i is not null then 'polygon' else shape_type end as shape_type,
  (case when p.i is not null then 3 when shape_type = 'rectangle' then 2 else 4 end)::bigint as n,
  case when p.i is not null then 'box_to_poly' else 'hand' end as source, label as k
from boxes left join (select 1 as c, 0 as i union all select 2, 0 union all select 2, 1) p on p.c = shape_idx % 3 and shape_type = 'rectangle'"""


def labelme_docs(s, d):
    rec = paired(s, d).select("image_id", F.element_at(F.split("image_path", "/"), -1).alias("image_name"), "width", "height")
    docs = J.to_labelme(rec, J.document_shapes(replaced(s, d)), shapes_per_doc=4)
    got = docs.select("image_id", "part", "doc_name", F.get_json_object("doc", "$.imagePath").alias("image_path"),
                      F.get_json_object("doc", "$.imageWidth").cast("int").alias("w"),
                      F.from_json(F.get_json_object("doc", "$.shapes"), "array<struct<label:string,points:array<array<double>>,shape_type:string>>").alias("sh"))
    return got.select("image_id", "part", "doc_name", "image_path", "w", F.size("sh").cast("bigint").alias("n_shapes"),
                      F.concat_ws(",", F.transform("sh", lambda x: F.concat(x["label"], F.lit(":"), F.size(x["points"])))).alias("labels"))


QUERIES["labelme_docs"] = labelme_docs
ORACLES["labelme_docs"] = X.with_sql("records", "boxes") + """,
r as (select image_id, shape_idx, coalesce(p.i, 0) as poly_idx, label, case when p.i is not null then 3 when shape_type = 'rectangle' then 2 else 4 end as n
  from boxes left join (select 1 as c, 0 as i union all select 2, 0 union all select 2, 1) p on p.c = shape_idx % 3 and shape_type = 'rectangle'),
k as (select *, row_number() over (partition by image_id order by shape_idx, poly_idx) as rn from r),
g as (select image_id, (rn - 1) // 4 as part, count(*) as n_shapes, string_agg(label || ':' || n, ',' order by rn) as labels from k group by 1, 2)
select image_id, coalesce(part, 0) as part, 'img_' || lpad(cast(image_id as varchar), 10, '0')
  || case when coalesce(part, 0) = 0 then '' else '__part' || lpad(cast(part as varchar), 4, '0') end || '.json' as doc_name,
  'img_' || lpad(cast(image_id as varchar), 10, '0') || '.png' as image_path, width as w, coalesce(n_shapes, 0) as n_shapes, coalesce(labels, '') as labels
from records left join g using (image_id)"""

QUERIES["existing_sources"] = lambda s, d: S.existing_sources(
    samples(s, d), X.images(s, d), X.documents(s, d)).groupBy("exists").agg(F.count(F.lit(1)).alias("n"))
ORACLES["existing_sources"] = _SAMPLES + """
select files.img is not null and o_orderkey is not null as "exists", count(*) as n from smp left join files using (img) left join orders on o_orderkey = l_orderkey group by 1"""
