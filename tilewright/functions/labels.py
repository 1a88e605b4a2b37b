"""String and tag expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


#: Values of the ``source`` flag on generated shapes (fixed values).
SOURCE_BATCHED = "sam1_box_to_poly"
SOURCE_OBJECT_TILE = "sam1_bbox_point"
SOURCE_PASTED = "paste_augment"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (SQL ``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_label(label: Column) -> Column:
    """Label in comparable form; a missing label compares as the empty string."""
    return F.lower(strip(F.coalesce(label, F.lit(""))))


def label_or_unknown(label: Column) -> Column:
    """Normalised label for object rows, where an empty one is reported as ``unknown``."""
    norm = normalize_label(label)
    return F.when(norm == "", F.lit("unknown")).otherwise(norm)


def fold(text: str) -> str:
    """Driver-side twin of :func:`normalize_label` for parameters."""
    return (text or "").strip().lower()


def choose_label_from_tags(tags: Column, allowed: Sequence[str]) -> Column:
    """First label of ``allowed`` (priority order) that occurs among the tags, ignoring case; NULL if none does."""
    present = F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalize_label)
    hits = [F.when(F.array_contains(present, fold(a)), F.lit(a)) for a in allowed if fold(a)]
    if not hits:
        raise ValueError("at least one label is needed")
    return F.coalesce(*hits)


def flags_with_source(flags: Column, source: str) -> Column:
    """Flags with ``source`` set, replacing an older value."""
    base = F.coalesce(flags, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, _: k != "source")
    return F.map_concat(rest, F.create_map(F.lit("source"), F.lit(source)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_ext(path: Column) -> Column:
    """Lower-case suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def hashed_image_name(path: Column) -> Column:
    """``stem__xxxxxxxx.ext`` with eight hex digits of the path's SHA-1, so that equal stems do not collide."""
    return F.concat(file_stem(path), F.lit("__"), F.substring(F.sha1(path.cast("binary")), 1, 8), file_ext(path))


def frame_name(stem: Column, index: Column) -> Column:
    return F.format_string("%s_%06d", stem, index)


def object_name(stem: Column, index: Column) -> Column:
    return F.format_string("%s__obj%04d", stem, index)


def screen_name(millis: Column, index: Column) -> Column:
    return F.format_string("screen_%d_%06d", millis, index)
