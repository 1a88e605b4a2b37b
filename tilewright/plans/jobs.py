"""Complete jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import SOURCE_BATCHED, SOURCE_OBJECT_TILE, file_stem, hashed_image_name, object_name
from tilewright.operators import components as C
from tilewright.operators.ranking import seeded_sample
from tilewright.operators import embeddings as V
from tilewright.operators import evaluate as E
from tilewright.operators import export as X
from tilewright.operators import grids as GR
from tilewright.operators import pasting as PA
from tilewright.operators import polygons as PO
from tilewright.operators import raster as RA
from tilewright.operators import selection as S
from tilewright.operators import tiling as T
from tilewright.session import pin
from tilewright.sources.writers import shape_struct, to_labelme

Candidates = Callable[[DataFrame], DataFrame]


def mask_outlines(candidates: DataFrame, min_area: float, epsilon_frac: float) -> DataFrame:
    """Best mask per prompt as ``image_id, shape_idx, polygons`` (``poly_idx, points``), one row each.

    ``candidates`` has ``image_id, shape_idx, cand_idx, score, cells`` (``array<struct<gy,gx>>``). Masks are outlined where
    they are, before the best is chosen among what different tasks have of a prompt.
    """
    return GR.pick_best_mask(PO.best_mask_polygons(candidates, min_area, epsilon_frac)).select("image_id", "shape_idx", "polygons")


def mask_polygons(outlined: DataFrame) -> DataFrame:
    """One row per polygon of :func:`mask_outlines`: ``image_id, shape_idx, poly_idx, points``."""
    return outlined.select("image_id", "shape_idx", F.explode("polygons").alias("_p")).select("image_id", "shape_idx", "_p.poly_idx", "_p.points")


def box_to_polygon_dataset(records: DataFrame, shapes: DataFrame, candidates: Candidates, mode: str = "bbox",
                           batch: int = 4, min_area: float = 20.0, epsilon_frac: float = 0.002,
                           source: str = SOURCE_BATCHED) -> tuple[DataFrame, DataFrame]:
    """Boxes (or points) to polygons by a mask model: the new shapes, and the conversion counts.

    ``candidates`` gets the batched prompts and returns scored masks. Prompts without a usable polygon keep their shape.
    The counts are of all records and of all shapes of the prompt type, degenerate ones included.
    """
    prompts = pin(T.batch_prompts(shapes, records, mode, batch))
    outlined = pin(mask_outlines(candidates(prompts), min_area, epsilon_frac))
    made = outlined.select("image_id", "shape_idx", F.size("polygons").alias("n_polygons"))
    scored = prompts.select("image_id", "shape_idx").join(made, ["image_id", "shape_idx"], "left").withColumn(
        "n_polygons", F.coalesce("n_polygons", F.lit(0)))
    asked = T.prompt_shapes(shapes, mode).select("image_id", "shape_idx").join(records, "image_id", "left_semi")
    counts = GR.conversion_counts(asked.join(scored, ["image_id", "shape_idx"], "left"), records)
    return X.replace_shapes(shapes, mask_polygons(outlined), source), counts


def object_tile_conversion(records: DataFrame, shapes: DataFrame, label: str, candidates: Candidates,
                           tile_size: int = 448, context_scale: float = 2.0, min_area: float = 20.0,
                           epsilon_frac: float = 0.002, source: str = SOURCE_OBJECT_TILE) -> DataFrame:
    """One crop per object of exactly this label; ``candidates`` gets the crop, the box and its midpoint in crop pixels.

    Records without such an object are left out.
    """
    proper = F.filter(F.array(G.bbox(F.col("points"))), lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
    boxed = shapes.where((F.col("label") == label) & (F.size("points") >= 2)).select("image_id", "shape_idx", F.explode(proper).alias("_s"))
    sized = boxed.join(S.valid_records(records), "image_id")
    box = G.stats_box(F.col("_s"))
    crops = (sized.withColumn("_w", G.object_tile_window(box, F.col("width"), F.col("height"), tile_size, context_scale))
             .where(F.col("_w").isNotNull()))
    side_x, side_y = (F.col("_w.x1") - F.col("_w.x0")).cast("double"), (F.col("_w.y1") - F.col("_w.y0")).cast("double")

    def local(v, origin, side):
        return F.greatest(F.lit(0.0), F.least(v - origin, side))

    asked = crops.select(
        "image_id", "shape_idx", F.col("_w.x0").alias("crop_x0"), F.col("_w.y0").alias("crop_y0"), F.col("_w.x1").alias("crop_x1"),
        F.col("_w.y1").alias("crop_y1"), local(F.col("_s.x0"), F.col("_w.x0"), side_x).alias("px0"),
        local(F.col("_s.y0"), F.col("_w.y0"), side_y).alias("py0"), local(F.col("_s.x1"), F.col("_w.x0"), side_x).alias("px1"),
        local(F.col("_s.y1"), F.col("_w.y0"), side_y).alias("py1"))
    asked = pin(asked.withColumns({"cx": 0.5 * (F.col("px0") + F.col("px1")), "cy": 0.5 * (F.col("py0") + F.col("py1"))}))
    polygons = mask_polygons(mask_outlines(candidates(asked), min_area, epsilon_frac))
    placed = polygons.join(asked.select("image_id", "shape_idx", "crop_x0", "crop_y0"), ["image_id", "shape_idx"]).select(
        "image_id", "shape_idx", "poly_idx", F.transform("points", lambda p: G.point(
            p["x"] + F.col("crop_x0"), p["y"] + F.col("crop_y0"))).alias("points"))
    kept = shapes.join(boxed.select("image_id").distinct(), "image_id", "left_semi")
    return X.replace_shapes(kept, placed, source)


def paste_dataset(records: DataFrame, shapes: DataFrame, donor_records: DataFrame, donor_shapes: DataFrame, label: str,
                  rules: PA.PasteRules = PA.PasteRules(), min_area: float = 20.0, low: float = 0.0005,
                  high: float = 0.02, brightness: DataFrame | None = None, max_images: int = 0, donor_max_images: int = 0,
                  sample_seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Donor pool, size distribution, placement plan and the shapes with the pasted ones appended.

    ``donor_max_images`` takes a seeded sample of the donor images, ``max_images`` the first images by identifier; 0 takes
    all. Pasted shapes below ``min_area`` are not appended.
    """
    records = S.valid_records(records)
    if max_images > 0:
        records = S.select_items(records, ["image_id"], max_items=max_images).drop("item_idx")
    if donor_max_images > 0:
        donor_records = seeded_sample(donor_records, donor_max_images, sample_seed, ["image_id"])
    donors = pin(PA.build_donor_pool(S.filter_labels(donor_shapes, [label]), donor_records, min_area))
    outlined = (S.filter_labels(shapes, [label])
                .select("image_id", "shape_idx", F.explode(F.array(G.shape_to_points(F.col("shape_type"), F.col("points")))).alias("points"))
                .where(F.size("points") >= 3).withColumn("_s", F.explode(F.array(G.outline_stats(F.col("points"))))))
    objects = pin(outlined.select("image_id", "shape_idx", "_s.x0", "_s.y0", "_s.x1", "_s.y1", G.stats_area(F.col("_s")).alias("area")).where("area > 0"))
    ratios = S.size_ratio_filter(
        objects.join(records, "image_id").select(G.area_ratio(F.col("area"), F.col("width"), F.col("height")).alias("ratio")), low, high)
    placed = pin(PA.plan_pastes(records, objects, donors, ratios, rules, brightness))
    pasted = PA.pasted_shapes(placed, donors, label, min_area)
    return placed, X.appended_shapes(shapes, pasted, "paste")


def build_object_samples(paired: DataFrame, shapes: DataFrame, labels: Sequence[str] = (), context_scale: float = 1.6,
                         tile_size: int = 224, min_poly_points: int = 3, max_objects: int = 0) -> DataFrame:
    """One row per usable object with its crop, normalised box and outline, ready for embedding.

    ``paired`` has ``image_id, image_path, json_path, width, height``.
    """
    rows = S.object_rows(shapes, labels, min_poly_points).select("image_id", "shape_idx", "label", "label_cf", "outline")
    rows = rows.withColumn("_s", G.outline_stats(F.col("outline"))).join(paired, "image_id")
    rows = rows.withColumn("_c", G.object_crop_window(G.stats_box(F.col("_s")), context_scale))
    rows = rows.withColumn("crop_points", G.points_in_crop(F.col("outline"), F.col("_c"), tile_size))
    rows = rows.withColumn("_l", G.outline_stats(F.col("crop_points")))
    side = F.lit(tile_size)
    stem = file_stem(F.col("image_path"))
    out = rows.select(
        "image_id", "shape_idx", F.col("image_path").alias("source_image_path"), F.col("json_path").alias("source_json_path"),
        F.col("shape_idx").cast("bigint").alias("source_obj_idx"),
        F.when(F.col("label_cf") == "unknown", "unknown").otherwise(F.regexp_replace("label", r"^\s+|\s+$", "")).alias("source_label"),
        G.area_ratio(G.stats_area(F.col("_s")), F.col("width"), F.col("height")).alias("area_ratio"),
        F.col("outline").alias("source_points"), F.concat(object_name(stem, F.col("shape_idx")), F.lit(".jpg")).alias("crop_name"),
        F.col("_c.x0").alias("crop_x0"), F.col("_c.y0").alias("crop_y0"), F.col("_c.side").alias("crop_side"),
        G.normalized_box(F.col("_l"), side, side).alias("object_bbox"),
        G.normalized_outline(F.col("crop_points"), side, side).alias("object_poly"))
    return S.cap_objects(out, max_objects)


def cluster_samples(samples: DataFrame, num_clusters: int = 12, seed: int = 42, n_init: int = 10) -> DataFrame:
    """Projection and cluster of embedded samples; ``embedding`` is normalised first."""
    unit = samples.withColumn("embedding", GR.l2_normalize(F.col("embedding")))
    return V.cluster_objects(V.project_2d(unit), num_clusters, "xy", seed, n_init)


def export_tagged(samples: DataFrame, images: DataFrame, shapes: DataFrame, sizes: DataFrame, allowed: Sequence[str],
                  order: Sequence[str], skip_index_zero: bool = False,
                  documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of the tagged objects, the copy manifest, and the counts.

    ``sizes`` has ``path, width, height``. Objects of images without a size have no document and are counted as
    ``skipped_unsized``, so the counts agree with what is written.
    """
    classified = pin(X.without_size(X.classify_samples(samples, images, shapes, allowed, skip_index_zero, documents), sizes))
    chosen = pin(X.selected_objects(classified, order))
    out_name = hashed_image_name(F.col("source_image_path"))
    per_image = chosen.select("source_image_path").distinct().join(
        sizes.select(F.col("path").alias("source_image_path"), "width", "height"), "source_image_path")
    records = per_image.select(F.col("source_image_path").alias("image_id"), out_name.alias("image_name"), "width", "height")
    ranked = chosen.select(F.col("source_image_path").alias("image_id"), F.struct(*order).alias("shape_idx"),
                           shape_struct(F.col("out_label"), F.col("outline")).alias("shape"))
    docs = to_labelme(records, ranked)
    stem = F.regexp_replace("image_name", r"(?<=.)\.[^.]*$", "")
    manifest = records.select(F.col("image_id").alias("source_image"), F.col("image_name").alias("output_image"),
                              F.concat(stem, F.lit(".json")).alias("output_json"))
    unsized = classified.agg(F.count_if(F.col("reason") == "unsized").alias("skipped_unsized"), F.lit(1).alias("_one"))
    counts = X.export_counts(classified, chosen).withColumn("_one", F.lit(1)).join(unsized, "_one").drop("_one")
    return docs, manifest, counts


def merged_instances(preds: DataFrame, records: DataFrame, stride: int, threshold: float, gate: str = "none",
                     gate_threshold: float = 0.5, dealt: bool = False) -> DataFrame:
    """Scored tiles → runs of merged cells above the threshold, ``image_id, det_id, gy, xs, xe, total``, by component.

    ``dealt`` tells how the tiles lie, as in :func:`grids.merge_rows`.
    """
    merged = GR.merge_rows(GR.gate_tiles(preds, gate, gate_threshold), records, stride, dealt)
    return pin(C.component_id(C.label_runs(GR.row_runs(merged, threshold), dealt)))


def evaluate_dataset(preds: DataFrame, records: DataFrame, objects: DataFrame, stride: int = 4,
                     threshold: float = 0.5, dealt: bool = False) -> DataFrame:
    """One row with all ten evaluation figures from scored tiles and annotated objects."""
    runs = merged_instances(preds, records, stride, threshold, dealt=dealt)
    det = pin(C.run_stats(runs, stride))
    ranges = runs.select("image_id", "det_id", F.col("xs").alias("_l"), F.col("xe").alias("_r"), F.col("gy").alias("_t"), F.col("gy").alias("_b"))
    gt_blocks = pin(RA.gt_blocks(objects, records, stride)[0])
    report = E.map_report(RA.range_blocks(ranges, ["image_id", "det_id"]), gt_blocks, det, pin(RA.gt_sizes(gt_blocks)))
    truth = objects.join(records.select("image_id", "width", "height"), "image_id")
    semantic = E.semantic_iou(E.cell_iou_per_image(runs, truth, records, stride))
    one = F.lit(1).alias("_one")
    return semantic.select("*", one).join(report.select("*", one), "_one").drop("_one")


def batch_inference(preds: DataFrame, records: DataFrame, stride: int, threshold: float = 0.5, gate: str = "hard",
                    gate_threshold: float = 0.5, min_area: float = 20.0,
                    epsilon_frac: float = 0.002) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored tiles to full-size polygons: the polygons, a report per image, and the mask as spans.

    The merged grid is resampled to the image size before it is cut at the threshold.
    """
    gated = GR.gate_tiles(preds, gate, gate_threshold)
    merged = pin(GR.merge_rows(gated, records, stride))
    sizes = records.selectExpr("image_id", f"cast(height div {int(stride)} as int) as gh",
                               f"cast(width div {int(stride)} as int) as gw", "height as out_h", "width as out_w")
    mask = pin(GR.row_spans_at(GR.upsample_bilinear(merged, sizes), threshold))
    runs = C.label_runs(mask.select("image_id", F.col("y").alias("gy"), "xs", "xe"))
    polygons = pin(PO.components_to_polygons(runs, min_area, epsilon_frac))
    report = GR.inference_report(records, GR.tile_cls_stats(preds), mask, polygons)
    return polygons, report, mask


def accepted_images(decisions: DataFrame) -> DataFrame:
    """Images that were ever accepted in a review log keyed by ``image_id``; only their polygons are ever exported."""
    return S.last_decisions(decisions.withColumnRenamed("image_id", "image_idx")).where("exported").select(
        F.col("image_idx").alias("image_id"))


def curation_export(polygons: DataFrame, records: DataFrame, decisions: DataFrame, label: str) -> DataFrame:
    """Documents of the images that were ever accepted in a review log keyed by ``image_id``."""
    accepted = accepted_images(decisions)
    chosen = records.join(accepted, "image_id", "left_semi")
    shapes = polygons.join(accepted, "image_id", "left_semi").select(
        "image_id", F.struct("comp_y", "comp_x").alias("shape_idx"), shape_struct(F.lit(label), F.col("points")).alias("shape"))
    return to_labelme(chosen, shapes)


def document_shapes(shapes: DataFrame) -> DataFrame:
    """Shape rows in the form :func:`to_labelme` takes, in (shape, piece) order."""
    order = F.struct("shape_idx", "poly_idx") if "poly_idx" in shapes.columns else F.col("shape_idx")
    group = F.col("group_id") if "group_id" in shapes.columns else None
    return shapes.select("image_id", order.alias("shape_idx"), shape_struct(
        F.col("label"), F.col("points"), group, F.col("shape_type"), F.col("flags")).alias("shape"))


