"""Seeded pseudo-random values that do not depend on partitioning or on the engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_digest(seed: Column | int | str, *key: Column) -> Column:
    """MD5 hex digest of ``seed:key``; its order is a reproducible shuffle of the keys."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", head.cast("string"), *[k.cast("string") for k in key]).cast("binary"))


def digest_int(digest: Column, start: int = 1, digits: int = 8) -> Column:
    """``digits`` hex digits of a digest as a non-negative bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def uniform(digest: Column, start: int = 1) -> Column:
    """A double in [0, 1) from eight hex digits of a digest."""
    return digest_int(digest, start) / F.lit(4294967296.0)


def draw_int(digest: Column, bound: Column, start: int = 1) -> Column:
    """An integer in [0, bound) from fifteen hex digits of a digest, so bounds up to 2^60 are drawn whole."""
    return digest_int(digest, start, 15) % bound
