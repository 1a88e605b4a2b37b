"""Documents, sample tables and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import file_name
from tilewright.operators.ranking import number_within

#: Version string written into documents (fixed value).
DOC_VERSION = "5.5.0"
#: Shapes per document before further ones go to a continuation document.
SHAPES_PER_DOC = 50_000


def shape_struct(label: Column, points: Column, group_id: Column | None = None, shape_type: Column | None = None,
                 flags: Column | None = None) -> Column:
    return F.struct(
        label.alias("label"), G.pairs_from_points(points).alias("points"),
        (F.lit(None).cast("bigint") if group_id is None else group_id).alias("group_id"),
        (F.lit("polygon") if shape_type is None else shape_type).alias("shape_type"),
        (F.create_map().cast("map<string,string>") if flags is None else flags).alias("flags"))


def to_labelme(records: DataFrame, shapes: DataFrame, shapes_per_doc: int = SHAPES_PER_DOC) -> DataFrame:
    """One document per record as ``image_id, part, doc_name, doc`` (JSON text), shapes in ``shape_idx`` order.

    ``records`` has ``image_id, image_name, width, height``; ``shapes`` has ``image_id, shape_idx, shape`` (a struct).
    A document must be one row, so an image with very many shapes is continued in ``__partNNNN`` documents: nothing is
    lost and no row grows without bound.
    """
    numbered = number_within(shapes, ["image_id"], ["shape_idx"], "_rank")
    parts = (numbered.withColumn("part", F.expr(f"(_rank - 1) div {int(shapes_per_doc)}"))
             .groupBy("image_id", "part")
             .agg(F.array_sort(F.collect_list(F.struct("_rank", "shape")),
                               lambda a, b: F.signum((a["_rank"] - b["_rank"]).cast("double")).cast("int")).alias("_s"))
             .withColumn("shapes", F.transform("_s", lambda s: s["shape"])))
    docs = records.join(parts, "image_id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    empty = F.array().cast(shapes.select(F.array("shape")).schema[0].dataType)
    stem = F.regexp_replace("image_name", r"(?<=.)\.[^.]*$", "")
    name = F.concat(stem, F.when(F.col("part") == 0, "").otherwise(F.format_string("__part%04d", F.col("part"))), F.lit(".json"))
    doc = F.to_json(F.struct(
        F.lit(DOC_VERSION).alias("version"), F.create_map().cast("map<string,string>").alias("flags"),
        F.coalesce("shapes", empty).alias("shapes"), F.col("image_name").alias("imagePath"),
        F.lit(None).cast("string").alias("imageData"), F.col("height").alias("imageHeight"),
        F.col("width").alias("imageWidth")), {"ignoreNullFields": "false"})
    return docs.select("image_id", "part", name.alias("doc_name"), doc.alias("doc"))


def write_documents(docs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Documents as Parquet rows ``doc_name, doc``; an existing target fails unless ``overwrite``."""
    docs.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_document_lines(docs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Documents as text, one JSON document per line."""
    docs.select("doc").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_document_files(docs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Documents as one text file each, below a folder per document name."""
    (docs.select("doc_name", "doc").write.mode("overwrite" if overwrite else "errorifexists")
     .partitionBy("doc_name").text(path))


def write_object_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    samples.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def copy_manifest(records: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """What to copy per exported record: ``source_image, output_image, output_json, passthrough``.

    ``records`` has ``image_id, image_path, json_path``. Records that are not in ``changed`` pass through unchanged.
    """
    rows = records.select("image_id", F.col("image_path").alias("source_image"),
                          file_name(F.col("image_path")).alias("output_image"),
                          file_name(F.col("json_path")).alias("output_json"))
    if changed is None:
        return rows.withColumn("passthrough", F.lit(True))
    keys = changed.select("image_id").distinct()
    done = rows.join(keys, "image_id", "left_semi").withColumn("passthrough", F.lit(False))
    same = rows.join(keys, "image_id", "left_anti").withColumn("passthrough", F.lit(True))
    return done.unionByName(same)
