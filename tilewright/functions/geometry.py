"""Geometry of shapes, boxes, crops and tiles as Column expressions.

Points are ``array<struct<x:double,y:double>>``. Rounding is half to even throughout (``rint``), and conversion to
integer truncates toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINTS_TYPE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def points_from_pairs(pairs: Column) -> Column:
    """``[[x, y], …]`` as stored in documents → points; pairs of another length are left out."""
    well_formed = F.filter(F.coalesce(pairs, F.array().cast("array<array<double>>")), lambda p: F.size(p) == 2)
    return F.transform(well_formed, lambda p: point(p[0], p[1]))


def pairs_from_points(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def outline_stats(points: Column) -> Column:
    """Everything a ring needs, from one pass over its vertices: box ``x0, y0, x1, y1``, count ``n``, coordinate sums
    ``sx, sy``, signed double area ``cross`` and its moments ``mx, my``. NULL without points.

    Store it in a column when several measures are wanted; the functions below take such a column.
    """
    last = F.element_at(points, -1)
    zero = F.lit(0.0)
    start = F.struct(F.lit(float("inf")).alias("x0"), F.lit(float("inf")).alias("y0"), F.lit(float("-inf")).alias("x1"),
                     F.lit(float("-inf")).alias("y1"), zero.alias("n"), zero.alias("sx"), zero.alias("sy"),
                     zero.alias("cross"), zero.alias("mx"), zero.alias("my"), last["x"].alias("px"), last["y"].alias("py"))

    def step(acc: Column, p: Column) -> Column:
        cross = acc["px"] * p["y"] - p["x"] * acc["py"]
        return F.struct(F.least(acc["x0"], p["x"]).alias("x0"), F.least(acc["y0"], p["y"]).alias("y0"),
                        F.greatest(acc["x1"], p["x"]).alias("x1"), F.greatest(acc["y1"], p["y"]).alias("y1"),
                        (acc["n"] + 1.0).alias("n"), (acc["sx"] + p["x"]).alias("sx"), (acc["sy"] + p["y"]).alias("sy"),
                        (acc["cross"] + cross).alias("cross"), (acc["mx"] + (acc["px"] + p["x"]) * cross).alias("mx"),
                        (acc["my"] + (acc["py"] + p["y"]) * cross).alias("my"), p["x"].alias("px"), p["y"].alias("py"))

    return F.when(F.size(points) > 0, F.aggregate(points, start, step))


def stats_box(s: Column) -> Column:
    return F.struct(s["x0"].alias("x0"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["y1"].alias("y1"))


def stats_area(s: Column) -> Column:
    """Shoelace area; 0 below three points."""
    return F.when(s["n"] >= 3, F.lit(0.5) * F.abs(s["cross"])).otherwise(F.lit(0.0))


def stats_mean(s: Column) -> Column:
    """Vertex mean."""
    return point(s["sx"] / s["n"], s["sy"] / s["n"])


def stats_centroid(s: Column) -> Column:
    """Area centroid; vertex mean for degenerate rings; (0, 0) for no points."""
    flat = (s["n"] < 3) | (F.abs(s["cross"]) < 1e-9)
    scale = F.when(~flat, 3.0 * s["cross"])
    zero = F.lit(0.0)
    return point(F.when(s.isNull(), zero).when(flat, s["sx"] / s["n"]).otherwise(s["mx"] / scale),
                 F.when(s.isNull(), zero).when(flat, s["sy"] / s["n"]).otherwise(s["my"] / scale))


def bbox(points: Column) -> Column:
    """Struct ``x0, y0, x1, y1`` around the points; NULL fields when there are none.

    Without a lambda, so that it costs a tenth of :func:`outline_stats` and may be copied into filters.
    """
    some, inf = F.size(points) > 0, F.lit(float("inf"))
    return F.struct(F.when(some, F.coalesce(F.array_min(points["x"]), inf)).alias("x0"), F.when(some, F.coalesce(F.array_min(points["y"]), inf)).alias("y0"),
                    F.when(some, F.coalesce(F.array_max(points["x"]), -inf)).alias("x1"), F.when(some, F.coalesce(F.array_max(points["y"]), -inf)).alias("y1"))


def coordinate_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(points: Column) -> Column:
    """:func:`stats_area` where nothing else of the ring is wanted."""
    last = F.element_at(points, -1)
    start = F.struct(F.lit(0.0).alias("cross"), last["x"].alias("px"), last["y"].alias("py"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["cross"] + (acc["px"] * p["y"] - p["x"] * acc["py"])).alias("cross"), p["x"].alias("px"), p["y"].alias("py"))

    return F.when(F.size(points) >= 3, F.lit(0.5) * F.abs(F.aggregate(points, start, step)["cross"])).otherwise(F.lit(0.0))


def polygon_area(points: Column) -> Column:
    return stats_area(outline_stats(points))


def vertex_mean(points: Column) -> Column:
    return stats_mean(outline_stats(points))


def polygon_centroid(points: Column) -> Column:
    return stats_centroid(outline_stats(points))


def is_rectangle(shape_type: Column) -> Column:
    return F.lower(F.coalesce(shape_type, F.lit(""))) == "rectangle"


def shape_to_points(shape_type: Column, points: Column, min_poly_points: int = 3) -> Column:
    """Outline of a shape: two rectangle corners become four; NULL when the shape has too few points."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    left, right = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    top, bottom = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
    corners = F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))
    rect = is_rectangle(shape_type)
    return (F.when(rect & (F.size(points) >= 2), corners)
            .when(~rect & (F.size(points) >= min_poly_points), points))


def shape_box(points: Column) -> Column:
    """Box of a shape, or NULL with fewer than two points or without extent."""
    box = bbox(points)
    return F.when((F.size(points) >= 2) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def corner_box(points: Column) -> Column:
    """Box between the first two points, in any order; NULL fields with fewer points."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    both = F.size(points) >= 2
    return F.struct(F.when(both, F.least(a["x"], b["x"])).alias("x0"), F.when(both, F.least(a["y"], b["y"])).alias("y0"),
                    F.when(both, F.greatest(a["x"], b["x"])).alias("x1"), F.when(both, F.greatest(a["y"], b["y"])).alias("y1"))


def rect_prompt(points: Column) -> Column:
    """Box and midpoint of a two-corner rectangle; NULL when it is degenerate."""
    box = corner_box(points)
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), F.struct(
        box.alias("box"), point(F.lit(0.5) * (box["x0"] + box["x1"]), F.lit(0.5) * (box["y0"] + box["y1"])).alias("point")))


def shape_prompt_point(shape_type: Column, points: Column, stats: Column | None = None) -> Column:
    """Midpoint of a rectangle, centroid of a polygon, NULL when the shape is not usable."""
    stats = outline_stats(points) if stats is None else stats
    return (F.when(is_rectangle(shape_type), rect_prompt(points)["point"])
            .when(F.size(points) >= 3, stats_centroid(stats)))


def box_iou(a: Column, b: Column) -> Column:
    """IoU of two box structs. Each area counts as at least 1; disjoint boxes give 0."""
    iw = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    ih = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    inter = iw * ih
    area_a = F.greatest(F.lit(1.0), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))
    area_b = F.greatest(F.lit(1.0), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / (area_a + area_b - inter))


def area_ratio(area: Column, width: Column, height: Column) -> Column:
    return area / F.greatest(F.lit(1.0), width.cast("double") * height.cast("double"))


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def box_to_tile(box: Column, x0: Column, y0: Column, size: Column) -> Column:
    """Box in tile coordinates, clamped to ``[0, size]``."""
    size = size.cast("double")
    return F.struct(clamp(box["x0"] - x0, 0.0, size).alias("x0"), clamp(box["y0"] - y0, 0.0, size).alias("y0"),
                    clamp(box["x1"] - x0, 0.0, size).alias("x1"), clamp(box["y1"] - y0, 0.0, size).alias("y1"))


def points_to_tile(points: Column, x0: Column, y0: Column, size: Column) -> Column:
    size = size.cast("double")
    return F.transform(points, lambda p: point(clamp(p["x"] - x0, 0.0, size), clamp(p["y"] - y0, 0.0, size)))


def scale_points(points: Column, sx: Column, sy: Column | None = None) -> Column:
    sy = sx if sy is None else sy
    return F.transform(points, lambda p: point(p["x"] * sx, p["y"] * sy))


def object_crop_window(box: Column, context_scale: float) -> Column:
    """Square crop ``x0, y0, side`` around an object; it may reach outside the image."""
    bw = F.greatest(F.lit(1.0), box["x1"] - box["x0"])
    bh = F.greatest(F.lit(1.0), box["y1"] - box["y0"])
    side = F.greatest(F.lit(16), F.ceil(F.greatest(bw, bh) * F.lit(float(context_scale))).cast("int"))
    left = F.rint(F.lit(0.5) * (box["x0"] + box["x1"]) - F.lit(0.5) * side).cast("int")
    top = F.rint(F.lit(0.5) * (box["y0"] + box["y1"]) - F.lit(0.5) * side).cast("int")
    return F.struct(left.alias("x0"), top.alias("y0"), side.alias("side"))


def points_in_crop(points: Column, window: Column, tile_size: int) -> Column:
    """Outline in the pixels of a crop that was resized to ``tile_size``."""
    factor = F.lit(float(tile_size)) / window["side"]
    edge = float(tile_size - 1)
    return F.transform(points, lambda p: point(clamp((p["x"] - window["x0"]) * factor, 0.0, edge),
                                               clamp((p["y"] - window["y0"]) * factor, 0.0, edge)))


def object_tile_window(box: Column, width: Column, height: Column, tile_size: int, context_scale: float) -> Column:
    """Square crop around an object, shifted to lie inside the image; NULL if it gets thinner than two pixels."""
    bw = F.greatest(F.lit(1.0), box["x1"] - box["x0"])
    bh = F.greatest(F.lit(1.0), box["y1"] - box["y0"])
    side = F.greatest(F.lit(tile_size), F.ceil(F.greatest(bw, bh) * F.lit(float(context_scale))).cast("int"))

    def start(lo: Column, hi: Column, extent: Column) -> Column:
        want = F.rint(F.lit(0.5) * (lo + hi) - side / F.lit(2.0)).cast("int")
        return F.greatest(F.lit(0), F.least(want, extent - side))

    left, top = start(box["x0"], box["x1"], width), start(box["y0"], box["y1"], height)
    right, bottom = F.least(width, left + side), F.least(height, top + side)
    return F.when((right - left >= 2) & (bottom - top >= 2), F.struct(
        left.alias("x0"), top.alias("y0"), right.alias("x1"), bottom.alias("y1")))


def crop_pad_rect(x0: Column, y0: Column, size: Column, width: Column, height: Column) -> Column:
    """Part of a crop that lies in the image, and where it is pasted in the padded crop."""
    sx0, sy0 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    return F.struct(sx0.alias("sx0"), sy0.alias("sy0"), F.least(width, x0 + size).alias("sx1"),
                    F.least(height, y0 + size).alias("sy1"), (sx0 - x0).alias("ox"), (sy0 - y0).alias("oy"))


def zoom_candidate_window(box: Column, width: Column, height: Column, tile_size: int) -> Column:
    """Crop with a 20 % margin (two pixels at least) and the box inside the resized crop; NULL if too thin."""
    bw = F.greatest(F.lit(1.0), box["x1"] - box["x0"])
    bh = F.greatest(F.lit(1.0), box["y1"] - box["y0"])
    mx, my = F.greatest(F.lit(2.0), bw * 0.2), F.greatest(F.lit(2.0), bh * 0.2)
    cx0 = F.greatest(F.lit(0), F.floor(box["x0"] - mx).cast("int"))
    cy0 = F.greatest(F.lit(0), F.floor(box["y0"] - my).cast("int"))
    cx1 = F.least(width, F.ceil(box["x1"] + mx).cast("int"))
    cy1 = F.least(height, F.ceil(box["y1"] + my).cast("int"))
    size = float(tile_size)
    sx = F.lit(size) / F.nullif(cx1 - cx0, F.lit(0))
    sy = F.lit(size) / F.nullif(cy1 - cy0, F.lit(0))
    zx0 = clamp((box["x0"] - cx0) * sx, 0.0, size - 1.0)
    zy0 = clamp((box["y0"] - cy0) * sy, 0.0, size - 1.0)
    zx1 = F.greatest(zx0 + 1.0, F.least(F.lit(size), (box["x1"] - cx0) * sx))
    zy1 = F.greatest(zy0 + 1.0, F.least(F.lit(size), (box["y1"] - cy0) * sy))
    return F.when((cx1 - cx0 >= 2) & (cy1 - cy0 >= 2), F.struct(
        cx0.alias("cx0"), cy0.alias("cy0"), cx1.alias("cx1"), cy1.alias("cy1"), zx0.alias("zx0"), zy0.alias("zy0"),
        zx1.alias("zx1"), zy1.alias("zy1"), (bw * bh).alias("area")))


def normalized_box(box: Column, crop_w: Column, crop_h: Column) -> Column:
    """Box of an object as ``x, y, w, h`` relative to its crop."""
    w = F.greatest(F.lit(1), crop_w).cast("double")
    h = F.greatest(F.lit(1), crop_h).cast("double")
    bw = F.greatest(F.lit(1.0), box["x1"] - box["x0"])
    bh = F.greatest(F.lit(1.0), box["y1"] - box["y0"])
    return F.struct(
        (F.greatest(F.lit(0.0), box["x0"]) / w).alias("x"), (F.greatest(F.lit(0.0), box["y0"]) / h).alias("y"),
        (F.least(crop_w.cast("double"), bw) / w).alias("w"), (F.least(crop_h.cast("double"), bh) / h).alias("h"))


def normalized_outline(points: Column, crop_w: Column, crop_h: Column) -> Column:
    w = F.greatest(F.lit(1), crop_w).cast("double")
    h = F.greatest(F.lit(1), crop_h).cast("double")
    return F.transform(points, lambda p: point(p["x"] / w, p["y"] / h))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


#: Upper edges of the size buckets, in pixels (fixed values).
SMALL_AREA = 32.0 ** 2
MEDIUM_AREA = 96.0 ** 2


def size_bucket(area: Column, small: float = SMALL_AREA, medium: float = MEDIUM_AREA) -> Column:
    return F.when(area < small, F.lit("small")).when(area < medium, F.lit("medium")).otherwise(F.lit("large"))


def tile_configs(tile_size: int, tile_stride: int, scales: Column) -> Column:
    """``"1.0,1.5"`` → distinct ``(size, stride)`` pairs in order; an empty list means scale 1."""
    tokens = F.filter(F.transform(F.split(scales, ","), lambda t: F.trim(t)), lambda t: t != "")
    tokens = F.when(F.size(tokens) == 0, F.array(F.lit("1.0"))).otherwise(tokens)
    return F.array_distinct(F.transform(tokens, lambda t: F.struct(
        F.greatest(F.lit(14), F.rint(F.lit(float(tile_size)) * t.cast("double")).cast("int")).alias("size"),
        F.greatest(F.lit(1), F.rint(F.lit(float(tile_stride)) * t.cast("double")).cast("int")).alias("stride"))))
