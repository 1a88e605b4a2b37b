"""Filters, row selection, top-k and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import fold, label_or_unknown, normalize_label
from tilewright.operators.ranking import number_rows, seeded_sample


def filter_labels(shapes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Keep the given labels; no label given keeps everything."""
    wanted = sorted({fold(x) for x in labels if fold(x)})
    return shapes.where(normalize_label(F.col("label")).isin(wanted)) if wanted else shapes


def valid_records(records: DataFrame, fallback_sizes: DataFrame | None = None) -> DataFrame:
    """Drop records without a positive size, after falling back to the real image size when it is given."""
    if fallback_sizes is not None:
        real = fallback_sizes.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
        bad = (F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0)
        records = (records.join(real, "image_id", "left")
                   .withColumns({"width": F.when(bad, F.col("_w")).otherwise(F.col("width")),
                                 "height": F.when(bad, F.col("_h")).otherwise(F.col("height"))})
                   .drop("_w", "_h"))
    return records.where((F.col("width") > 0) & (F.col("height") > 0))


def objects_from_shapes(shapes: DataFrame, target: str, fp_label: str | None = None, min_poly_points: int = 3,
                        positive_area: bool = False) -> DataFrame:
    """Shapes of the target label (and of the false-positive label) as objects with box, centre and area.

    A label equal to both counts as target. Rectangles need two points, anything else ``min_poly_points``.
    """
    wanted, fp = fold(target), fold(fp_label) if fp_label is not None else None
    kind = F.lower(F.coalesce(F.col("shape_type"), F.lit("")))
    # a stored point count spares the filter from evaluating the points
    count = F.col("n_points") if "n_points" in shapes.columns else F.size("points")
    rect, n = F.col("shape_type") == "rectangle", F.col("_n")
    named = shapes.select("image_id", "shape_idx", normalize_label(F.col("label")).alias("label_cf"), count.alias("_n"),
                          F.when(kind == "", F.lit("polygon")).otherwise(kind).alias("shape_type"), "points")
    wanted_here = F.col("label_cf").isin([wanted] if fp is None else sorted({wanted, fp}))
    kept = named.where(wanted_here & F.when(rect, n >= 2).otherwise(n >= min_poly_points))
    # one measure a column, so that those which nobody asks for are not computed; the box through an array of one, so that
    # filters on it don't evaluate the points again and again
    kept = kept.withColumn("_b", F.explode(F.array(G.bbox(F.col("points")))))
    box = F.col("_b")
    sx, sy = G.coordinate_sum(F.col("points")["x"]), G.coordinate_sum(F.col("points")["y"])
    area = F.when(rect, (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])).otherwise(G.ring_area(F.col("points")))
    out = kept.select("image_id", "shape_idx", "label_cf", (F.col("label_cf") != wanted).alias("is_fp"), "shape_type",
                      "points", *[box[c].alias(c) for c in ("x0", "y0", "x1", "y1")], (sx / n).alias("cx"), (sy / n).alias("cy"),
                      area.alias("area"))
    return out.where(F.col("area") > 0) if positive_area else out


def object_rows(shapes: DataFrame, labels: Sequence[str] = (), min_poly_points: int = 3) -> DataFrame:
    """Shapes with their outline; an empty label reads ``unknown``, unusable outlines are dropped."""
    return (filter_labels(shapes, labels)
            .withColumn("outline", G.shape_to_points(F.col("shape_type"), F.col("points"), min_poly_points))
            .where(F.col("outline").isNotNull())
            .withColumn("label_cf", label_or_unknown(F.col("label"))))


#: Area ratios used when no annotated one lies in the wanted range (fixed values).
FALLBACK_RATIOS = (0.001, 0.002, 0.003, 0.005, 0.008)


def size_ratio_filter(ratios: DataFrame, low: float, high: float) -> DataFrame:
    """Ratios within ``[low, high]``; a fixed list when there are none."""
    kept = ratios.where(F.col("ratio").between(low, high)).select("ratio")
    spark = ratios.sparkSession
    defaults = spark.createDataFrame([(r, 1) for r in FALLBACK_RATIOS], "ratio double, one int")
    any_kept = kept.limit(1).select(F.lit(1).alias("one"))
    return kept.unionByName(defaults.join(any_kept, "one", "left_anti").select("ratio"))


def min_area_filter(polygons: DataFrame, min_area: float) -> DataFrame:
    return polygons.where((F.col("area") >= min_area) & (F.size("points") >= 3))


def existing_sources(samples: DataFrame, images: DataFrame, documents: DataFrame) -> DataFrame:
    """Flag samples whose image and document are both listed (column ``exists``)."""
    have_image = images.select(F.col("path").alias("source_image_path"), F.lit(True).alias("_img")).distinct()
    have_doc = documents.select(F.col("path").alias("source_json_path"), F.lit(True).alias("_doc")).distinct()
    return (samples.join(have_image, "source_image_path", "left").join(have_doc, "source_json_path", "left")
            .withColumn("exists", F.col("_img").isNotNull() & F.col("_doc").isNotNull()).drop("_img", "_doc"))


def select_items(items: DataFrame, order: Sequence[str], start: int = 0, every: int = 1, max_items: int = 0,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Skip the first ``start`` items of each key, keep every ``every``-th and at most ``max_items`` (0 = all).

    Adds ``item_idx``, the 1-based number among the kept items.
    """
    every = max(1, every)
    pos = F.col("_rank") - 1 - start
    kept = (number_rows(items, keys, order, "_rank").where((pos >= 0) & (pos % every == 0))
            .withColumn("item_idx", F.expr(f"(_rank - 1 - {int(start)}) div {int(every)} + 1")).drop("_rank"))
    return kept.where(F.col("item_idx") <= max_items) if max_items > 0 else kept


def sample_frames_at_fps(frames: DataFrame, fps: float, source: str = "source", seconds: str = "seconds",
                         index: str = "frame_idx") -> DataFrame:
    """One frame per ``1/fps`` slot: the frame nearest to the slot's time, the earlier one on a tie."""
    slot = F.rint(F.col(seconds) * fps).cast("bigint")
    with_slot = frames.withColumn("slot", slot)
    gap = F.abs(F.col(seconds) - F.col("slot") / F.lit(float(fps)))
    rest = [c for c in frames.columns if c not in (source, index)]
    best = F.min_by(F.struct(F.col(index), *rest), F.struct(gap, F.col(index)))
    return (with_slot.groupBy(source, "slot").agg(best.alias("_f")).select(source, "slot", "_f.*"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key. Spark keeps one row per key and task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; Spark prunes to ``k`` rows per key and task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def largest_per_image(polygons: DataFrame) -> DataFrame:
    """Largest polygon per image, the first one on a tie."""
    return first_per_key(polygons, ["image_id"], [F.col("area").desc(), F.col("shape_idx")])


def top_boxes(boxes: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` largest boxes per image; boxes up to one pixel thin are dropped."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    usable = boxes.where((w > 1) & (h > 1)).withColumn("box_area", w * h)
    return top_per_key(usable, ["image_id"], [F.col("box_area").desc(), F.col("shape_idx")], k)


def cap_objects(objects: DataFrame, max_objects: int) -> DataFrame:
    """First ``max_objects`` objects in (file, shape) order; 0 keeps all."""
    if max_objects <= 0:
        return objects
    return (number_rows(objects, [], ["image_id", "shape_idx"], "_rank")
            .where(F.col("_rank") <= max_objects).drop("_rank"))


def dedup_objects(items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row per (image, shape, label): the first in ``order``."""
    return first_per_key(items, ["image_id", "shape_idx", "out_label"], order)


#: Key → action of the review log (fixed values). Other keys only move the cursor.
REVIEW_KEYS = {"a": "accept", "A": "accept", "d": "reject", "D": "reject"}


def last_decisions(log: DataFrame) -> DataFrame:
    """Final state per image from a review log ``seq, image_idx, key``.

    A later decision replaces an earlier one, but a document exported by an accept stays exported.
    """
    action = F.when(F.col("key").isin("a", "A"), "accept").when(F.col("key").isin("d", "D"), "reject")
    return (log.withColumn("action", action).where(F.col("action").isNotNull())
            .groupBy("image_idx")
            .agg(F.max_by("action", "seq").alias("state"), F.max("seq").alias("last_seq"),
                 F.sum(F.when(F.col("action") == "accept", 1).otherwise(0)).alias("n_accepts"))
            .withColumn("exported", F.col("n_accepts") > 0))


def stems_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("stem").intersect(right.select("stem"))


def stems_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("stem").distinct().join(right.select("stem").distinct(), "stem", "left_anti")


def sample_gallery(objects: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` seeded random images among those with a usable outline, with their object count."""
    counts = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_objects"))
    return seeded_sample(counts, n, seed, ["image_id"])


#: Weight of the old value in the smoothed rate (fixed value).
RATE_KEEP = 0.9
_RATE_BLOCK = 512


def smoothed_rate(samples: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """``s = 0.9·s + 0.1·x`` per key in index order, starting with the first positive value; column ``smoothed``.

    Values are rates and so never negative; before the first positive one the smoothed rate is 0.

    The recurrence is linear, so a block of 512 samples can be summed on its own with weights ``0.9^-i``. What a block
    inherits from the blocks before its predecessor is scaled by less than 0.9^512 ≈ 4e-24, below the precision of a
    double, so the predecessor's own end value is all it needs. The index must be dense from 0.
    """
    pos = (F.col(index) % _RATE_BLOCK).cast("double")
    block = F.expr(f"{index} div {_RATE_BLOCK}")
    starts = samples.where(F.col(value) > 0).groupBy(key).agg(F.min(index).alias("_start")).withColumnRenamed(key, "_k")
    samples = samples.join(starts, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    weight = F.when(F.col(index) == F.col("_start"), F.lit(1.0)).otherwise(F.lit(1.0 - RATE_KEEP))
    inside = W.partitionBy(key, "_block").orderBy(index).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = (samples.withColumn("_block", block)
             .withColumn("_own", F.sum(weight * F.col(value) / F.pow(F.lit(RATE_KEEP), pos)).over(inside)
                         * F.pow(F.lit(RATE_KEEP), pos)))
    ends = (local.groupBy(key, "_block").agg(F.max_by("_own", index).alias("_carry"))
            .withColumn("_block", F.col("_block") + 1))
    return (local.join(ends, [key, "_block"], "left")
            .withColumn("smoothed", F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(RATE_KEEP), pos + 1))
            .drop("_block", "_own", "_carry", "_start"))


def save_policy(results: DataFrame, save_empty: bool, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Results that are saved: all, or only those with polygons. ``save_idx`` is the running number of the item."""
    numbered = number_rows(results, keys, order, "save_idx")
    return numbered if save_empty else numbered.where(F.col("n_polygons") > 0)


def infer_gate(frames: DataFrame, every: int, start: int | None = None) -> DataFrame:
    """Frames that are scored.

    Live mode (``start`` is None): the first frame of a stream and every frame whose index is a multiple of ``every``.
    Media mode: every ``every``-th frame counted from ``start``.
    """
    every = max(1, every)
    if start is not None:
        return frames.where((F.col("frame_idx") >= start) & ((F.col("frame_idx") - start) % every == 0))
    first = frames.groupBy("stream_id").agg(F.min("frame_idx").alias("_first"))
    return (frames.join(first, "stream_id")
            .where((F.col("frame_idx") % every == 0) | (F.col("frame_idx") == F.col("_first"))).drop("_first"))
