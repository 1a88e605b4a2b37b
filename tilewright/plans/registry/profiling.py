"""Profiles of an annotation set, row selection and sampling."""

from pyspark.sql import functions as F

from tilewright.operators import profile as P
from tilewright.operators import selection as S
from tilewright.operators.ranking import exact_quantiles, number_rows, seeded_sample
from tilewright.plans import fixtures as X
from tilewright.plans.registry.shapes import objects
from tilewright.sources.readers import pair_images, with_file_parts

QUERIES, ORACLES = {}, {}


def _r(col, name=None):
    return F.round(col, 6).alias(name or col)


QUERIES["dataset_peek"] = lambda s, d: P.dataset_peek(X.records(s, d), X.shapes(s, d), "vehicle").select(
    "n_images", "n_objects", "n_labels", F.round("mean_ratio", 9).alias("mean_ratio"),
    F.round("median_ratio", 9).alias("median_ratio"), F.round("p90_ratio", 9).alias("p90_ratio"), "below_1pct", "below_05pct",
    "below_01pct")
ORACLES["dataset_peek"] = X.with_sql("records", "boxes", "objects") + """,
ratios as (select area / (width * height) as r from objects join records using (image_id) where label_cf = 'vehicle')
select (select count(*) from records) as n_images, count(*) as n_objects,
  (select count(distinct label) from boxes) as n_labels, round(avg(r), 9) as mean_ratio,
  round(quantile_cont(r, 0.5), 9) as median_ratio, round(quantile_cont(r, 0.9), 9) as p90_ratio,
  count(*) filter (r < 0.01) as below_1pct, count(*) filter (r < 0.005) as below_05pct,
  count(*) filter (r < 0.001) as below_01pct from ratios"""


def _image_stems(s, d):
    return with_file_parts(X.images(s, d))


QUERIES["pair_summary"] = lambda s, d: P.pair_summary(X.documents(s, d), _image_stems(s, d))
ORACLES["pair_summary"] = X.with_sql("stems") + """,
i as (select distinct stem from imgs)
select 'json_files' as metric, (select count(distinct stem) from docs)::double as value
union all select 'image_files', (select count(*) from i)
union all select 'paired_records', (select count(*) from docs join i using (stem))
union all select 'images_missing_json', (select count(*) from i anti join docs using (stem))
union all select 'json_missing_image', (select count(*) from docs anti join i using (stem))"""

for _policy, _order in (("preference", "list_position(['.png','.jpg','.jpeg','.gif','.tif','.tiff'], lower(ext)), stem || ext"),
                        ("name", "stem || ext")):
    QUERIES[f"pair_images_{_policy}"] = lambda s, d, p=_policy: pair_images(
        X.documents(s, d), _image_stems(s, d), p).select("stem", "image_path")
    ORACLES[f"pair_images_{_policy}"] = X.with_sql("stems") + f""",
picked as (select stem, ext, row_number() over (partition by stem order by {_order}) as n from imgs)
select stem, '/data/' || stem || ext as image_path from docs join picked using (stem) where n = 1"""

QUERIES["stem_sets"] = lambda s, d: (
    S.stems_in_both(X.documents(s, d), _image_stems(s, d)).withColumn("side", F.lit("both"))
    .unionByName(S.stems_only_in(X.documents(s, d), _image_stems(s, d)).withColumn("side", F.lit("doc")))
    .unionByName(S.stems_only_in(_image_stems(s, d), X.documents(s, d)).withColumn("side", F.lit("image"))))
ORACLES["stem_sets"] = X.with_sql("stems") + """
select stem, 'both' as side from (select stem from docs intersect select stem from imgs)
union all select stem, 'doc' from (select stem from docs except select stem from imgs)
union all select stem, 'image' from (select stem from imgs except select stem from docs)"""

QUERIES["annotation_summary"] = lambda s, d: P.annotation_summary(
    X.records(s, d), X.shapes(s, d), X.documents(s, d), _image_stems(s, d)).select("metric", _r("value"))
ORACLES["annotation_summary"] = X.with_sql("records", "boxes", "stems") + """,
c as (select count(b.image_id) as n from records r left join boxes b using (image_id) group by r.image_id),
p as (select case when shape_type = 'rectangle' then 2 else 4 end as n from boxes)
select metric, round(value, 6) as value from (
select 'records_total' as metric, count(*)::double as value from c
union all select 'images_total', (select count(distinct stem) from imgs)
union all select 'paired_records', (select count(*) from (select stem from docs intersect select stem from imgs))
union all select 'annotations_total', sum(n) from c
union all select 'annotations_per_image_min', min(n) from c
union all select 'annotations_per_image_mean', avg(n) from c
union all select 'annotations_per_image_median', quantile_cont(n, 0.5) from c
union all select 'annotations_per_image_max', max(n) from c
union all select 'annotations_per_image_p90', quantile_cont(n, 0.9) from c
union all select 'annotations_per_image_p95', quantile_cont(n, 0.95) from c
union all select 'annotations_per_image_p99', quantile_cont(n, 0.99) from c
union all select 'images_with_zero_annotations', count(*) filter (n = 0) from c
union all select 'unique_image_widths', count(distinct width) from records
union all select 'unique_image_heights', count(distinct height) from records
union all select 'polygon_points_min', min(n) from p
union all select 'polygon_points_mean', avg(n) from p
union all select 'polygon_points_median', quantile_cont(n, 0.5) from p
union all select 'polygon_points_max', max(n) from p)"""

QUERIES["distinct_sizes"] = lambda s, d: P.distinct_sizes(X.records(s, d))
ORACLES["distinct_sizes"] = X.with_sql("records") + """
select distinct 'width' as axis, width as size from records union all select distinct 'height', height from records"""

for _column in ("label", "shape_type"):
    QUERIES[f"{_column}_counts"] = lambda s, d, c=_column: P.value_counts(X.shapes(s, d), c).select(c, "count", _r("pct"))
    ORACLES[f"{_column}_counts"] = X.with_sql("boxes") + f"""
select coalesce({_column}, '<missing>') as {_column}, count(*) as "count", round(100.0 * count(*) / sum(count(*)) over (), 6) as pct
from boxes group by 1"""

QUERIES["annotation_hist"] = lambda s, d: P.annotation_histogram(
    P.profile_records(X.records(s, d), X.shapes(s, d))).select("annotation_count", "num_images", _r("pct_images"))
ORACLES["annotation_hist"] = X.with_sql("records", "boxes") + """,
c as (select count(b.image_id) as annotation_count from records r left join boxes b using (image_id) group by r.image_id)
select annotation_count, count(*) as num_images, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct_images
from c group by 1"""

QUERIES["ratio_hist25"] = lambda s, d: P.fixed_bin_histogram(
    P.ratio_samples(X.records(s, d), objects(s, d)), "ratio").select("bin", _r("lo"), _r("hi"), "count")
ORACLES["ratio_hist25"] = X.with_sql("records", "boxes", "objects") + """,
v as (select area / (width * height) as r from objects join records using (image_id)),
e as (select min(r) as lo, max(r) as hi from v),
c as (select least(floor((r - lo) * 25 / (hi - lo))::int, 24) as bin, count(*) as n from v, e group by 1)
select b.range::int as bin, round(lo + b.range * ((hi - lo) / 25.0), 6) as lo, round(lo + (b.range + 1) * ((hi - lo) / 25.0), 6) as hi,
  coalesce(n, 0) as "count" from range(25) b cross join e left join c on c.bin = b.range"""

QUERIES["profile_shapes"] = lambda s, d: P.profile_shapes(X.shapes(s, d))
ORACLES["profile_shapes"] = X.with_sql("boxes") + """
select image_id, shape_idx, label, shape_type, (case when shape_type = 'rectangle' then 2 else 4 end)::bigint as num_points,
  bx as min_x, bx + bw as max_x, by_ as min_y, by_ + bh as max_y from boxes"""

QUERIES["profile_records"] = lambda s, d: P.profile_records(X.records(s, d), X.shapes(s, d))
ORACLES["profile_records"] = X.with_sql("records", "boxes") + """
select r.image_id, width, height, count(b.image_id) as annotation_count from records r left join boxes b using (image_id)
group by all"""

QUERIES["discover_labels"] = lambda s, d: P.labels_seen(X.shapes(s, d))
ORACLES["discover_labels"] = X.with_sql("boxes") + "select distinct trim(label) as label from boxes where trim(label) <> ''"

QUERIES["record_totals"] = lambda s, d: P.record_totals(X.records(s, d), objects(s, d))
ORACLES["record_totals"] = X.with_sql("records", "boxes") + """
select (select count(*) from records) as n_records, count(distinct image_id) as n_with_objects, count(*) as n_objects from boxes"""

QUERIES["object_count_distribution"] = lambda s, d: P.object_count_distribution(X.records(s, d), objects(s, d))
ORACLES["object_count_distribution"] = X.with_sql("records", "boxes") + """,
c as (select count(b.image_id) as n_objects from records r left join boxes b using (image_id) group by r.image_id)
select n_objects, count(*) as n_images from c group by 1"""

QUERIES["size_ratio_filter"] = lambda s, d: S.size_ratio_filter(
    P.ratio_samples(X.records(s, d), objects(s, d)), 0.001, 0.02).agg(
    F.count(F.lit(1)).alias("n"), _r(F.sum("ratio"), "total"), F.min("ratio").alias("lowest"), F.max("ratio").alias("highest"))
ORACLES["size_ratio_filter"] = X.with_sql("records", "boxes", "objects") + """,
v as (select area / (width * height) as r from objects join records using (image_id))
select count(*) as n, round(sum(r), 6) as total, min(r) as lowest, max(r) as highest from v where r between 0.001 and 0.02"""

QUERIES["ratio_quantiles"] = lambda s, d: exact_quantiles(
    P.ratio_samples(X.records(s, d), objects(s, d), ["label_cf"]), "ratio", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["label_cf"]).select(
    "label_cf", *[F.round(c, 9).alias(c) for c in ("p10", "p50", "p99")])
ORACLES["ratio_quantiles"] = X.with_sql("records", "boxes", "objects") + """,
v as (select label_cf, area / (width * height) as r from objects join records using (image_id))
select label_cf, round(quantile_cont(r, 0.1), 9) as p10, round(quantile_cont(r, 0.5), 9) as p50, round(quantile_cont(r, 0.99), 9) as p99
from v group by 1"""

QUERIES["sample_gallery"] = lambda s, d: S.sample_gallery(objects(s, d), 12, 42)
ORACLES["sample_gallery"] = X.with_sql("boxes") + """
select image_id, count(*) as n_objects from boxes group by 1 order by md5(concat('42:', cast(image_id as varchar))), image_id limit 12"""

QUERIES["seeded_sample"] = lambda s, d: seeded_sample(X.records(s, d), 500, 7, ["image_id"])
ORACLES["seeded_sample"] = X.with_sql("records") + """
select * from records order by md5(concat('7:', cast(image_id as varchar))), image_id limit 500"""

QUERIES["largest_donor"] = lambda s, d: S.largest_per_image(objects(s, d)).select("image_id", "shape_idx", _r("area"))
ORACLES["largest_donor"] = X.with_sql("boxes", "objects") + """
select image_id, shape_idx, round(area, 6) as area from objects
qualify row_number() over (partition by image_id order by area desc, shape_idx) = 1"""

QUERIES["top_boxes"] = lambda s, d: S.top_boxes(objects(s, d), 6).select(
    "image_id", "shape_idx", F.col("rank").cast("bigint").alias("rank"), "box_area")
ORACLES["top_boxes"] = X.with_sql("boxes", "objects") + """
select image_id, shape_idx, row_number() over (partition by image_id order by (x1 - x0) * (y1 - y0) desc, shape_idx) as "rank",
  (x1 - x0) * (y1 - y0) as box_area from objects where x1 - x0 > 1 and y1 - y0 > 1
qualify "rank" <= 6"""

QUERIES["cap_objects"] = lambda s, d: S.cap_objects(objects(s, d), 1000).select("image_id", "shape_idx")
ORACLES["cap_objects"] = X.with_sql("boxes") + "select image_id, shape_idx from boxes order by image_id, shape_idx limit 1000"

QUERIES["decisions"] = lambda s, d: S.last_decisions(X.decisions(s, d))
ORACLES["decisions"] = """
with log as (select event_id as seq, user_id as image_idx, case event_type when 'purchase' then 'accept' when 'error' then 'reject' end as action from events)
select image_idx, arg_max(action, seq) as state, max(seq) as last_seq, count(*) filter (action = 'accept') as n_accepts,
  count(*) filter (action = 'accept') > 0 as exported from log where action is not null group by 1"""


def _rates(s, d):
    e = X.table(s, d, "events").select("user_id", "event_id", "value")
    return number_rows(e, ["user_id"], ["event_id"], "_n").select("user_id", (F.col("_n") - 1).alias("idx"), "value")


QUERIES["fps_ema"] = lambda s, d: S.smoothed_rate(_rates(s, d), "user_id", "idx", "value").select(
    "user_id", "idx", F.round(F.col("smoothed") + 3.14159e-10, 6).alias("smoothed"))
ORACLES["fps_ema"] = """
with recursive v as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as idx, value from events),
ema as (select user_id, idx, value as s from v where idx = 0
  union all select v.user_id, v.idx, case when ema.s <= 0 then v.value else 0.9::double * ema.s + 0.1::double * v.value end from ema join v on v.user_id = ema.user_id and v.idx = ema.idx + 1)
select user_id, idx, round(s + 3.14159e-10::double, 6) as smoothed from ema"""

QUERIES["select_items"] = lambda s, d: S.select_items(
    X.documents(s, d).select("stem"), ["stem"], start=10, every=3, max_items=2000)
ORACLES["select_items"] = X.with_sql("stems") + """,
n as (select stem, row_number() over (order by stem) - 11 as k from docs)
select stem, k // 3 + 1 as item_idx from n where k >= 0 and k % 3 = 0 and k // 3 < 2000"""


def _timed(s, d):
    e = X.table(s, d, "events")
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return e.select(F.col("user_id").alias("source"), F.col("event_id").alias("frame_idx"),
                    (micros.cast("double") / 1000000.0).alias("seconds"))


QUERIES["frames_at_fps"] = lambda s, d: S.sample_frames_at_fps(_timed(s, d), 1.0 / 86400.0).select("source", "slot", "frame_idx")
ORACLES["frames_at_fps"] = """
with f as (select user_id as source, event_id as frame_idx, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000.0::double as t from events),
s as (select *, round_even(t * (1.0::double / 86400.0::double), 0)::bigint as slot from f)
select source, slot, frame_idx from s
qualify row_number() over (partition by source, slot order by abs(t - slot / (1.0::double / 86400.0::double)), frame_idx) = 1"""

QUERIES["infer_gate_live"] = lambda s, d: S.infer_gate(X.frames(s, d), 2).select("stream_id", "frame_idx")
ORACLES["infer_gate_live"] = """
select user_id as stream_id, event_id as frame_idx from events
qualify event_id % 2 = 0 or row_number() over (partition by user_id order by event_id) = 1"""

QUERIES["infer_gate_media"] = lambda s, d: S.infer_gate(X.frames(s, d), 3, start=5).select("stream_id", "frame_idx")
ORACLES["infer_gate_media"] = """
select user_id as stream_id, event_id as frame_idx from events where event_id >= 5 and (event_id - 5) % 3 = 0"""

QUERIES["save_policy"] = lambda s, d: S.save_policy(
    X.frames(s, d).select("stream_id", "frame_idx", F.size("detections").cast("bigint").alias("n_polygons")), False,
    ["frame_idx"], ["stream_id"])
ORACLES["save_policy"] = """
select * from (select user_id as stream_id, event_id as frame_idx, (case when event_type = 'error' then 0 else 1 end)::bigint as n_polygons,
  row_number() over (partition by user_id order by event_id) as save_idx from events) where n_polygons > 0"""
