"""Image kernels over grey pixels (rows `id`, `width`, `height`, `pixels` binary), numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _grey(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width).astype(np.float64)


def box_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with the filter widened to the scale, as image libraries do when they shrink."""
    for axis, size in ((0, height), (1, width)):
        n = a.shape[axis]
        scale = max(n / size, 1.0)
        centre = (np.arange(size) + 0.5) * n / size
        weight = np.clip(1 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale, 0, None)
        a = np.moveaxis(np.tensordot(weight / weight.sum(1, keepdims=True), a, (1, axis)), 0, axis)
    return a


def difference_hashes(images: DataFrame) -> DataFrame:
    """(id, dhash): 64 bits, left > right on a 9 x 8 grey image, as 16 hex digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            small = [np.rint(box_resize(_grey(r), 8, 9)) for r in b.itertuples()]
            yield pd.DataFrame({"id": b["id"], "dhash": [np.packbits(s[:, :-1] > s[:, 1:]).tobytes().hex() for s in small]})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {dict(images.dtypes)['id']}, dhash string")


def quality(images: DataFrame, *, dark_below: float = 0.15, blurry_below: float = 25.0) -> DataFrame:
    """(id, brightness, sharpness, dark, blurry): mean grey of 255 and variance of the Laplacian; flags use unrounded values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grey = [_grey(r) for r in b.itertuples()]
            bright = [float(g.mean() / 255) for g in grey]
            lap = [np.pad(g, 1, mode="reflect") for g in grey]
            sharp = [float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var()) for p in lap]
            yield pd.DataFrame({"id": b["id"], "brightness": bright, "sharpness": sharp, "dark": [x < dark_below for x in bright], "blurry": [x < blurry_below for x in sharp]})

    return images.select("id", "width", "height", "pixels").mapInPandas(run, f"id {dict(images.dtypes)['id']}, brightness double, sharpness double, dark boolean, blurry boolean")
