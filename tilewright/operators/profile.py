"""Profiling of annotation sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import fold, normalize_label
from tilewright.operators.ranking import exact_quantiles, seeded_sample
from tilewright.session import pin


def pair_integrity(documents: DataFrame, images: DataFrame) -> DataFrame:
    """One row per stem with flags ``has_doc`` and ``has_image``."""
    docs = documents.select("stem").distinct().withColumn("_d", F.lit(True))
    imgs = images.select("stem").distinct().withColumn("_i", F.lit(True))
    return (docs.join(imgs, "stem", "full_outer")
            .select("stem", F.col("_d").isNotNull().alias("has_doc"), F.col("_i").isNotNull().alias("has_image")))


def _as_metrics(row: DataFrame, names: Sequence[str]) -> DataFrame:
    """One wide row → (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def pair_summary(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Five counts about the pairing of documents and images by stem."""
    both = pair_integrity(documents, images)
    d, i = F.col("has_doc"), F.col("has_image")
    row = both.agg(F.count_if(d).alias("json_files"), F.count_if(i).alias("image_files"),
                   F.count_if(d & i).alias("paired_records"), F.count_if(i & ~d).alias("images_missing_json"),
                   F.count_if(d & ~i).alias("json_missing_image"))
    return _as_metrics(row, row.columns)


def profile_shapes(shapes: DataFrame) -> DataFrame:
    """Per shape: label, type, number of points and extent. ``n_points`` (if present) counts ill-formed points too."""
    shapes = shapes.withColumn("_s", G.outline_stats(F.col("points")))
    box = F.col("_s")
    n = F.col("n_points") if "n_points" in shapes.columns else F.size("points")
    return shapes.select("image_id", "shape_idx", "label", "shape_type", n.cast("bigint").alias("num_points"),
                         box["x0"].alias("min_x"), box["x1"].alias("max_x"), box["y0"].alias("min_y"),
                         box["y1"].alias("max_y"))


def profile_records(records: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per record: size and number of annotations, zero included."""
    counts = shapes.groupBy("image_id").agg(F.count(F.lit(1)).alias("annotation_count"))
    return (records.join(counts, "image_id", "left")
            .withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0))))


ANNOTATION_METRICS = (
    "records_total", "images_total", "paired_records", "annotations_total", "annotations_per_image_min",
    "annotations_per_image_mean", "annotations_per_image_median", "annotations_per_image_max",
    "annotations_per_image_p90", "annotations_per_image_p95", "annotations_per_image_p99",
    "images_with_zero_annotations", "unique_image_widths", "unique_image_heights", "polygon_points_min",
    "polygon_points_mean", "polygon_points_median", "polygon_points_max")


def annotation_summary(records: DataFrame, shapes: DataFrame, documents: DataFrame, images: DataFrame) -> DataFrame:
    """Eighteen metrics of an annotation set as (metric, value). The distinct sizes are reported as counts here;
    :func:`distinct_sizes` lists them."""
    per_record = profile_records(records, shapes)
    n = F.col("annotation_count")
    base = per_record.agg(
        F.count(F.lit(1)).alias("records_total"), F.sum(n).alias("annotations_total"),
        F.min(n).alias("annotations_per_image_min"), F.avg(n).alias("annotations_per_image_mean"),
        F.max(n).alias("annotations_per_image_max"), F.count_if(n == 0).alias("images_with_zero_annotations"))
    sizes = distinct_sizes(records).agg(F.count_if(F.col("axis") == "width").alias("unique_image_widths"),
                                        F.count_if(F.col("axis") == "height").alias("unique_image_heights"))
    counts_q = exact_quantiles(per_record, "annotation_count", {
        "annotations_per_image_median": 0.5, "annotations_per_image_p90": 0.9, "annotations_per_image_p95": 0.95,
        "annotations_per_image_p99": 0.99})
    pts = profile_shapes(shapes).select("num_points")
    points = pts.agg(F.min("num_points").alias("polygon_points_min"), F.avg("num_points").alias("polygon_points_mean"),
                     F.max("num_points").alias("polygon_points_max"))
    points_q = exact_quantiles(pts, "num_points", {"polygon_points_median": 0.5})
    pairs = pair_integrity(documents, images).agg(
        F.count_if(F.col("has_image")).alias("images_total"),
        F.count_if(F.col("has_doc") & F.col("has_image")).alias("paired_records"))
    out = None
    for part in (base, sizes, counts_q, points, points_q, pairs):
        rows = _as_metrics(part, part.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def distinct_sizes(records: DataFrame) -> DataFrame:
    """Distinct widths and heights as (axis, size)."""
    both = F.array(F.struct(F.lit("width").alias("axis"), F.col("width").alias("size")),
                   F.struct(F.lit("height").alias("axis"), F.col("height").alias("size")))
    return (records.select(F.explode(both).alias("s")).select("s.axis", "s.size")
            .where(F.col("size").isNotNull()).distinct())


def value_counts(df: DataFrame, column: str, missing: str = "<missing>") -> DataFrame:
    """Count and percentage per value, NULL shown as ``missing``."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count", "pct")


def with_share(counts: DataFrame, count: str, name: str) -> DataFrame:
    """Percentage of the total. The total is a one-row frame joined on a constant, so no task holds all groups."""
    total = counts.agg(F.sum(count).alias("_total")).withColumn("_one", F.lit(1))
    return (counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
            .withColumn(name, F.lit(100.0) * F.col(count) / F.col("_total")).drop("_one", "_total"))


def annotation_histogram(per_record: DataFrame) -> DataFrame:
    """Images per annotation count, with percentage."""
    counts = per_record.groupBy("annotation_count").agg(F.count(F.lit(1)).alias("num_images"))
    return with_share(counts, "num_images", "pct_images")


def fixed_bin_histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Equal-width bins between minimum and maximum, which falls in the last bin. Empty bins are listed.

    A constant column is spread over ±0.5, as the usual plotting library does.
    """
    present = pin(df.select(F.col(value).cast("double").alias("_v"), F.lit(1).alias("_one")).where(F.col("_v").isNotNull()))
    edge = present.groupBy("_one").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    edge = edge.select("_one", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    slot = F.least(F.floor((F.col("_v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))).cast("int"),
                   F.lit(bins - 1))
    counts = (present.join(F.broadcast(edge), "_one").groupBy(slot.alias("bin"))
              .agg(F.count(F.lit(1)).alias("_n")))
    frame = edge.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (frame.join(counts, "bin", "left")
            .select("bin", (F.col("_lo") + F.col("bin") * step).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * step).alias("hi"), F.coalesce("_n", F.lit(0)).alias("count")))


def dataset_peek(records: DataFrame, shapes: DataFrame, label: str, max_images: int = 0, seed: int = 42) -> DataFrame:
    """One row about a (sampled) set: images, objects of the label, labels seen and the distribution of area ratios."""
    chosen = records.where((F.col("width") > 0) & (F.col("height") > 0))
    if max_images > 0:
        chosen = seeded_sample(chosen, max_images, seed, ["image_id"])
    n_images = chosen.agg(F.count(F.lit(1)).alias("n_images"))
    # a rectangle's outline has the area of its box, so its corners need not be spelled out
    rect = G.is_rectangle(F.col("shape_type"))
    box = G.corner_box(F.col("points"))
    flat = shapes.select("image_id", "label", rect.alias("_r"), (box["x1"] - box["x0"]).alias("_bw"),
                         (box["y1"] - box["y0"]).alias("_bh"), F.when(~rect, G.outline_stats(F.col("points"))).alias("_s"))
    area = F.coalesce(F.when(F.col("_r"), F.col("_bw") * F.col("_bh")).otherwise(G.stats_area(F.col("_s"))), F.lit(0.0))
    rows = (flat.select("image_id", "label", area.alias("_area"))
            .join(chosen.select("image_id", "width", "height"), "image_id"))
    wanted = normalize_label(F.col("label")) == fold(label)
    ratio = F.when(wanted & (F.col("_area") > 0), G.area_ratio(F.col("_area"), F.col("width"), F.col("height")))
    ratios = pin(rows.select(F.coalesce("label", F.lit("")).alias("label"), ratio.alias("ratio")))
    per_label = ratios.groupBy("label").agg(
        F.count("ratio").alias("n"), F.sum("ratio").alias("s"), F.count_if(F.col("ratio") < 0.01).alias("c1"),
        F.count_if(F.col("ratio") < 0.005).alias("c2"), F.count_if(F.col("ratio") < 0.001).alias("c3"))
    stats = per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_objects"), F.count(F.lit(1)).alias("n_labels"),
        (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_ratio"), F.sum("c1").alias("below_1pct"),
        F.sum("c2").alias("below_05pct"), F.sum("c3").alias("below_01pct"))
    quantiles = exact_quantiles(ratios, "ratio", {"median_ratio": 0.5, "p90_ratio": 0.9})
    one = F.lit(1).alias("_one")
    return (n_images.select("*", one).join(stats.select("*", one), "_one", "left")
            .join(quantiles.select("*", one), "_one", "left").drop("_one"))


def labels_seen(shapes: DataFrame) -> DataFrame:
    """Distinct trimmed labels that are not empty, sorted."""
    trimmed = F.regexp_replace("label", r"^\s+|\s+$", "")
    return shapes.select(trimmed.alias("label")).where(F.col("label") != "").distinct().orderBy("label")


def record_totals(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Number of records, of records with objects, and of objects."""
    per = profile_records(records, objects)
    n = F.col("annotation_count")
    return per.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(n > 0).alias("n_with_objects"),
                   F.sum(n).alias("n_objects"))


def object_count_distribution(records: DataFrame, objects: DataFrame) -> DataFrame:
    """Images per object count."""
    return (profile_records(records, objects).groupBy(F.col("annotation_count").alias("n_objects"))
            .agg(F.count(F.lit(1)).alias("n_images")))


def ratio_samples(records: DataFrame, objects: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Area ratio of every object, with the columns ``also`` of the object."""
    return (objects.select("image_id", "shape_idx", *also, "area").join(records, "image_id")
            .select("image_id", "shape_idx", *also,
                    G.area_ratio(F.col("area"), F.col("width"), F.col("height")).alias("ratio")))
