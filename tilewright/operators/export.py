"""Tagged objects back to documents, and shapes replaced by polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import choose_label_from_tags, flags_with_source
from tilewright.operators.selection import existing_sources, first_per_key


def classify_samples(samples: DataFrame, images: DataFrame, shapes: DataFrame, allowed: Sequence[str],
                     skip_index_zero: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """Samples with ``out_label``, ``outline`` and ``reason`` (``valid``, ``unlabeled`` or ``invalid``).

    The outline comes from the sample, or else from the source document's shape at the sample's index. ``shapes`` has
    ``json_path, shape_idx, shape_type, points``. ``documents`` (``path``) are the documents that exist, with or without
    shapes; without it they are those of ``shapes``.
    """
    idx = F.col("source_obj_idx")
    idx = F.when(idx == 0, F.lit(-1)).otherwise(idx) if skip_index_zero else idx
    tagged = samples.withColumns({"out_label": choose_label_from_tags(F.col("tags"), allowed), "_idx": idx.cast("bigint"),
                                  "_own": F.coalesce(F.size("source_points") >= 3, F.lit(False))})
    if documents is None:
        documents = shapes.select(F.col("json_path").alias("path"))
    documents = documents.select("path").distinct()
    found = existing_sources(tagged, images, documents)
    source = shapes.select(F.col("json_path").alias("source_json_path"), F.col("shape_idx").cast("bigint").alias("_idx"),
                           G.shape_to_points(F.col("shape_type"), F.col("points")).alias("_fallback"))
    # whether there is an outline is known before the joins, so outlines need not go along where nobody asks for them
    source = source.withColumn("_drawn", F.size("_fallback") >= 3)
    own = F.when(F.size("source_points") >= 3, F.col("source_points"))
    joined = found.join(source, ["source_json_path", "_idx"], "left").withColumn("outline", F.coalesce(own, F.col("_fallback")))
    usable = ((F.col("source_image_path") != "") & (F.col("source_json_path") != "") & (F.col("_idx") >= 0)
              & F.col("exists") & (F.col("_own") | F.coalesce("_drawn", F.lit(False))))
    reason = (F.when(F.col("out_label").isNull(), "unlabeled").when(usable, "valid").otherwise("invalid"))
    return joined.withColumn("reason", reason).drop("_fallback", "exists", "_own", "_drawn")


def without_size(classified: DataFrame, sizes: DataFrame) -> DataFrame:
    """Valid samples of images that ``sizes`` (``path``) does not have get the reason ``unsized``."""
    known = sizes.select(F.col("path").alias("source_image_path")).distinct().withColumn("_sized", F.lit(True))
    lost = (F.col("reason") == "valid") & F.col("_sized").isNull()
    return (classified.join(known, "source_image_path", "left")
            .withColumn("reason", F.when(lost, "unsized").otherwise(F.col("reason"))).drop("_sized"))


def selected_objects(classified: DataFrame, order: Sequence[str]) -> DataFrame:
    """Valid samples, one per (image, object, label): the first in ``order``."""
    valid = classified.where(F.col("reason") == "valid")
    return first_per_key(valid, ["source_image_path", "_idx", "out_label"], [F.col(c) for c in order])


def export_counts(classified: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected objects, exported images, and what was skipped why."""
    skipped = classified.agg(F.count_if(F.col("reason") == "unlabeled").alias("skipped_unlabeled"),
                             F.count_if(F.col("reason") == "invalid").alias("skipped_invalid"),
                             F.count_if(F.col("reason") == "valid").alias("_valid"), F.lit(1).alias("_one"))
    kept = (selected.groupBy("source_image_path").agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("exported_shapes"), F.count(F.lit(1)).alias("exported_images"),
                 F.lit(1).alias("_one")))
    return (skipped.join(kept, "_one")
            .withColumn("duplicates", F.col("_valid") - F.col("exported_shapes")).drop("_one", "_valid"))


def replace_shapes(shapes: DataFrame, replacements: DataFrame, source: str) -> DataFrame:
    """Shapes with some replaced by polygons, in the old order.

    ``replacements`` has ``image_id, shape_idx, poly_idx, points``. A replaced shape keeps label, group and flags, and
    gets the source flag; others stay as they are. ``poly_idx`` orders the pieces of one shape.
    """
    new = replacements.select("image_id", "shape_idx", "poly_idx", F.col("points").alias("_new"))
    joined = shapes.join(new, ["image_id", "shape_idx"], "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns({
        "points": F.coalesce("_new", "points"), "poly_idx": F.coalesce("poly_idx", F.lit(0)),
        "shape_type": F.when(hit, "polygon").otherwise(F.col("shape_type")),
        "flags": F.when(hit, flags_with_source(F.col("flags"), source)).otherwise(F.col("flags")),
        "replaced": hit}).drop("_new")


def appended_shapes(shapes: DataFrame, extra: DataFrame, order: str) -> DataFrame:
    """Shapes followed by extra ones, numbered on from the last index of their image."""
    last = shapes.groupBy("image_id").agg(F.max("shape_idx").alias("_last"))
    moved = (extra.join(last, "image_id", "left")
             .withColumn("shape_idx", (F.coalesce("_last", F.lit(-1)) + 1 + F.col(order)).cast(shapes.schema["shape_idx"].dataType))
             .drop("_last", order))
    return shapes.unionByName(moved, allowMissingColumns=True)
