"""User-supplied models on batches of tiles, crops or prompts, and the pixels they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

#: Channel mean and standard deviation for normalised tiles, red-green-blue (fixed values).
PIXEL_MEAN = (0.485, 0.456, 0.406)
PIXEL_STD = (0.229, 0.224, 0.225)


def score(df: DataFrame, make_scorer: Callable[[], Scorer], schema: str | T.StructType, batch_size: int = 32,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """Run a model over the rows of ``df``.

    ``make_scorer`` loads the model once per task and returns a function from a batch (at most ``batch_size`` rows) to
    a frame with the columns of ``schema``, row by row. ``keep`` names input columns passed through.
    """
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    full = T.StructType([df.schema[k] for k in keep] + list(out.fields))
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at:at + batch_size].reset_index(drop=True)
                result = scorer(part)
                if len(result) != len(part):
                    raise ValueError(f"the scorer returned {len(result)} rows for {len(part)}")
                merged = {k: part[k] for k in keep} | {n: result[n].to_numpy() if hasattr(result[n], "to_numpy") else result[n] for n in names}
                yield pd.DataFrame(merged)

    return df.mapInPandas(run, full)


def _resize(crop: np.ndarray, size: int) -> np.ndarray:
    """Bilinear resize of a square crop, corners not aligned."""
    n = crop.shape[0]
    if n == size:
        return crop
    src = np.maximum((np.arange(size) + 0.5) * (n / size) - 0.5, 0.0)
    lo = np.minimum(src.astype(np.int64), n - 1)
    hi = np.minimum(lo + 1, n - 1)
    w = src - lo
    rows = crop[lo] * (1 - w)[:, None, None] + crop[hi] * w[:, None, None]
    return rows[:, lo] * (1 - w)[None, :, None] + rows[:, hi] * w[None, :, None]


def padded_crop(image: np.ndarray, x0: int, y0: int, size: int) -> np.ndarray:
    """Square crop with zeros outside the image."""
    out = np.zeros((size, size, image.shape[2]), dtype=np.float64)
    h, w = image.shape[:2]
    sx0, sy0, sx1, sy1 = max(0, x0), max(0, y0), min(w, x0 + size), min(h, y0 + size)
    if sx1 > sx0 and sy1 > sy0:
        out[sy0 - y0:sy1 - y0, sx0 - x0:sx1 - x0] = image[sy0:sy1, sx0:sx1]
    return out


def extract_tile_pixels(tiles: DataFrame, pixels: DataFrame, tile_size: int, normalize: bool = True) -> DataFrame:
    """Pixels of each tile as ``array<float>``: channel, row, column; channels red, green, blue.

    ``tiles`` has ``image_id, src_tile_size, x0, y0``; ``pixels`` has ``image_id, width, height, channels, data`` with
    blue-green-red bytes. The tile list of an image travels to its pixels, so an image is moved once, not per tile.
    """
    image_type = tiles.schema["image_id"].dataType.simpleString()
    per_image = tiles.groupBy("image_id").agg(F.collect_list(F.struct("src_tile_size", "x0", "y0")).alias("_t"))
    rows = pixels.select("image_id", "width", "height", "channels", "data").join(per_image, "image_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, std = np.array(PIXEL_MEAN), np.array(PIXEL_STD)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)[:, :, :3][:, :, ::-1]
                for t in r[5]:
                    crop = _resize(padded_crop(image, t["x0"], t["y0"], t["src_tile_size"]), tile_size)
                    if normalize:
                        crop = (crop / 255.0 - mean) / std
                    yield pd.DataFrame({"image_id": [r.image_id], "src_tile_size": [t["src_tile_size"]], "x0": [t["x0"]],
                                        "y0": [t["y0"]], "pixels": [crop.transpose(2, 0, 1).astype(np.float32).ravel()]})

    return rows.mapInPandas(run, f"image_id {image_type}, src_tile_size int, x0 int, y0 int, pixels array<float>")
