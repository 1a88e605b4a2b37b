"""Readers of annotation documents, images, frames, object samples and run metrics. No reader infers a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tilewright.functions import geometry as G
from tilewright.functions.labels import file_ext, file_name, file_stem
from tilewright.operators.selection import first_per_key
from tilewright.schema import ANNOTATION_DOC, FRAMES, OBJECT_SAMPLES, RUN_METRICS

#: Image suffixes in order of preference (fixed values).
IMAGE_EXTS = (".png", ".jpg", ".jpeg", ".gif", ".tif", ".tiff")


def read_annotations(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """One row per ``*.json`` document: ``json_path, stem, json_bytes`` and its fields.

    ``on_corrupt`` is ``fail`` or ``skip``. A document that is not an object with the expected types counts as corrupt.
    """
    if on_corrupt not in ("fail", "skip"):
        raise ValueError(on_corrupt)
    text = (spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("json_path"), F.col("_metadata.file_size").alias("json_bytes"),
                    F.col("value")))
    return _parse_documents(text, on_corrupt)


def read_written_documents(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """Documents that :func:`tilewright.sources.writers.write_documents` wrote, as :func:`read_annotations` gives them.

    Continuation documents (``__partNNNN``) are put together again, shapes in their order.
    """
    rows = spark.read.schema("doc_name string, doc string").parquet(path)
    docs = _parse_documents(rows.select(F.col("doc_name").alias("json_path"), F.octet_length("doc").cast("bigint").alias("json_bytes"),
                                        F.col("doc").alias("value")), on_corrupt)
    part = F.coalesce(F.expr("try_cast(nullif(regexp_extract(stem, '__part([0-9]+)$', 1), '') as int)"), F.lit(0))
    whole = docs.withColumns({"_part": part, "stem": F.regexp_replace("stem", "__part[0-9]+$", "")})
    pieces = F.array_sort(F.collect_list(F.struct("_part", "shapes")), lambda a, b: F.signum((a["_part"] - b["_part"]).cast("double")).cast("int"))
    rest = [F.min_by(c, "_part").alias(c) for c in docs.columns if c not in ("stem", "shapes", "json_bytes")]
    joined = whole.groupBy("stem").agg(*rest, F.sum("json_bytes").alias("json_bytes"), pieces.alias("_s"))
    return joined.withColumn("shapes", F.flatten(F.transform("_s", lambda s: s["shapes"]))).select(*docs.columns)


def _parse_documents(text: DataFrame, on_corrupt: str) -> DataFrame:
    mode = "FAILFAST" if on_corrupt == "fail" else "PERMISSIVE"
    schema = ANNOTATION_DOC
    if on_corrupt == "skip":
        schema = type(ANNOTATION_DOC)(ANNOTATION_DOC.fields).add("_corrupt", "string")
    parsed = F.from_json("value", schema, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"})
    docs = text.withColumn("_d", parsed)
    if on_corrupt == "skip":
        docs = docs.where(F.col("_d").isNotNull() & F.col("_d._corrupt").isNull())
    fields = [F.col(f"_d.{f.name}").alias(f.name) for f in ANNOTATION_DOC.fields]
    return docs.select("json_path", file_stem(F.col("json_path")).alias("stem"), "json_bytes", *fields)


def list_images(spark: SparkSession, path: str, exts: Sequence[str] = IMAGE_EXTS) -> DataFrame:
    """Image files by suffix, case ignored: ``path, stem, ext, length, mtime``. File contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    return with_file_parts(files).where(F.col("ext").isin([e.lower() for e in exts]))


def with_file_parts(files: DataFrame) -> DataFrame:
    return files.withColumns({"stem": file_stem(F.col("path")), "ext": file_ext(F.col("path"))})


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: ``path, width, height, channels, data`` (rows of blue-green-red bytes)."""
    return (spark.read.format("image").option("dropInvalid", True).load(path)
            .select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
                    F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
                    F.col("image.data").alias("data")))


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the images that :func:`read_pixels` leaves out because they can't be decoded."""
    found = spark.read.format("image").load(path)
    return found.where(F.col("image.width") < 0).select(F.col("image.origin").alias("path"))


def pair_images(documents: DataFrame, images: DataFrame, policy: str = "preference",
                exts: Sequence[str] = IMAGE_EXTS) -> DataFrame:
    """Documents with one image of the same stem: columns of ``documents`` plus ``image_path``.

    Policies: ``preference`` (suffix order of ``exts``), ``name`` (first by file name), ``png`` (that suffix only).
    """
    rank: Column = F.lit(0)
    usable = images.where(F.col("ext").isin(list(exts)))
    if policy == "png":
        usable = images.where(F.col("ext") == ".png")
    elif policy == "preference":
        rank = F.array_position(F.array(*[F.lit(e) for e in exts]), F.col("ext"))
    elif policy != "name":
        raise ValueError(policy)
    best = first_per_key(usable.select("stem", "path", rank.alias("_r"), file_name(F.col("path")).alias("_n")), ["stem"],
                         [F.col("_r"), F.col("_n"), F.col("path")])
    return documents.join(best.select("stem", F.col("path").alias("image_path")), "stem")


def records_and_shapes(docs: DataFrame, image_id: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Documents → ``records`` (missing sizes are 0) and ``shapes`` (one row per shape, position as ``shape_idx``)."""
    zero = F.lit(0)
    records = docs.select(F.col(image_id).alias("image_id"), F.coalesce("imageWidth", zero).alias("width"),
                          F.coalesce("imageHeight", zero).alias("height"))
    rows = docs.select(F.col(image_id).alias("image_id"), F.posexplode("shapes").alias("shape_idx", "_s"))
    shapes = rows.select(
        "image_id", "shape_idx", F.col("_s.label").alias("label"), F.coalesce("_s.shape_type", F.lit("")).alias("shape_type"),
        G.points_from_pairs(F.col("_s.points")).alias("points"),
        F.coalesce(F.size("_s.points"), zero).alias("n_points"), F.col("_s.group_id").alias("group_id"),
        F.coalesce("_s.flags", F.create_map().cast("map<string,string>")).alias("flags"))
    return records, shapes


def read_frame_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Unbounded frames with detections from a growing Parquet folder."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", max_files).parquet(path)


def read_object_samples(spark: SparkSession, path: str) -> DataFrame:
    """Tagged object samples; missing paths, index and tags get their defaults."""
    raw = spark.read.schema(OBJECT_SAMPLES).parquet(path)
    return raw.withColumns({
        "source_image_path": F.coalesce("source_image_path", F.lit("")),
        "source_json_path": F.coalesce("source_json_path", F.lit("")),
        "source_obj_idx": F.coalesce("source_obj_idx", F.lit(-1).cast("bigint")),
        "tags": F.coalesce("tags", F.array().cast("array<string>"))})


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of many runs from ``<run>/history.json``; the run is the folder name when a row does not name it."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = spark.read.schema(RUN_METRICS).option("pathGlobFilter", "history.json").option("multiLine", True) \
        .option("recursiveFileLookup", True).json(path)
    return rows.withColumn("run", F.coalesce("run", folder))
