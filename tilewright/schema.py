"""Explicit schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINTS = T.ArrayType(POINT)

RAW_SHAPE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("group_id", T.LongType()),
    T.StructField("shape_type", T.StringType()),
    T.StructField("flags", T.MapType(T.StringType(), T.StringType())),
])

#: One annotation document, as stored on disk.
ANNOTATION_DOC = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("flags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("shapes", T.ArrayType(RAW_SHAPE)),
    T.StructField("imagePath", T.StringType()),
    T.StructField("imageData", T.StringType()),
    T.StructField("imageHeight", T.IntegerType()),
    T.StructField("imageWidth", T.IntegerType()),
])

DETECTION = T.StructType([
    T.StructField("poly", POINTS),
    T.StructField("x0", T.DoubleType()),
    T.StructField("y0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
])

#: One row per frame of a stream, with the detections found on it.
FRAMES = T.StructType([
    T.StructField("stream_id", T.LongType()),
    T.StructField("frame_idx", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("detections", T.ArrayType(DETECTION)),
])

OBJECT_SAMPLES = T.StructType([
    T.StructField("source_image_path", T.StringType()),
    T.StructField("source_json_path", T.StringType()),
    T.StructField("source_obj_idx", T.LongType()),
    T.StructField("source_label", T.StringType()),
    T.StructField("area_ratio", T.DoubleType()),
    T.StructField("source_points", POINTS),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("xy", T.ArrayType(T.FloatType())),
    T.StructField("cluster", T.IntegerType()),
])

STEP_METRICS = ("total", "mcc", "bce", "boundary", "tile_cls", "zoom_cls", "fp_sup", "soft_iou", "pos_iou",
                "neg_fp_rate", "fp_activation")

RUN_METRICS = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("split", T.StringType()),
     T.StructField("epoch", T.IntegerType()), T.StructField("step", T.LongType())]
    + [T.StructField(name, T.DoubleType()) for name in STEP_METRICS]
)
