"""Hashes and statistics of images, as Spark's image source decodes them, from their pixels.

Images of one shape in an Arrow batch are worked on together: grey levels, the average of each cell of
a ``SIDE`` x ``SIDE`` raster, the two-dimensional cosine transform of the raster as two matrix products.
Of the transform the ``KEEP`` x ``KEEP`` lowest frequencies after the constant ones give a bit each: set
where the coefficient is above their median, the first at bit 0. So the hash depends on the picture's
coarse shape, not on its size, brightness or contrast.

Defined results: what isn't decoded (a null, a mode below 0, data of another length than height x
width x channels, no pixels) has null hash and statistics; 1, 3 and 4 channels are known, others count
as not decoded; alpha isn't looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, KEEP = 32, 8
# Weights of blue, green and red in a grey level.
GREY = (0.114, 0.587, 0.299)
OUT = "origin string, p_hash long, mean double, entropy double"


def _averages(n: int) -> np.ndarray:
    """A matrix that takes n values to the averages of SIDE equal stretches of them."""
    edges = np.linspace(0, n, SIDE + 1)
    at = np.arange(n)
    overlap = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    return overlap / (n / SIDE)


def _cosines() -> np.ndarray:
    """The transform's rows of frequencies 1 to KEEP."""
    k, i = np.arange(1, KEEP + 1)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE)) * np.sqrt(2 / SIDE)


def grey_levels(data: np.ndarray) -> np.ndarray:
    """images x height x width of images x height x width x channels."""
    return data[..., 0].astype(float) if data.shape[-1] == 1 else data[..., :3] @ np.array(GREY)


def hashes(grey: np.ndarray) -> np.ndarray:
    """The hash of each image of one shape."""
    small = _averages(grey.shape[1]) @ grey @ _averages(grey.shape[2]).T
    waves = (_cosines() @ small @ _cosines().T).reshape(len(grey), -1)
    # coefficients that differ in the last places only are equal
    waves = np.round(waves, 9)
    bits = waves > np.median(waves, axis=1, keepdims=True)
    return (bits.astype(np.uint64) << np.arange(KEEP * KEEP, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _entropy(grey: np.ndarray) -> list[float]:
    """Bits a pixel, of levels rounded to 0 to 255."""
    out = []
    for levels in np.rint(grey).astype(int).reshape(len(grey), -1):
        p = np.bincount(levels, minlength=256) / levels.size
        p = p[p > 0]
        out.append(float(-(p * np.log2(p)).sum()) + 0.0)
    return out


def pixel_features(images: DataFrame, image: str = "image") -> DataFrame:
    """origin, p_hash, mean, entropy of a column as the image source gives it."""

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            out = pd.DataFrame({"origin": pdf["origin"], "p_hash": pd.array([None] * len(pdf), "Int64"), "mean": None, "entropy": None})
            length = pdf["data"].map(lambda d: -1 if d is None else len(d))
            sound = (pdf["mode"].fillna(-1) >= 0) & (length > 0) & (length == pdf["height"] * pdf["width"] * pdf["nChannels"]) & pdf["nChannels"].isin([1, 3, 4])
            for (h, w, c), rows in pdf[sound].groupby(["height", "width", "nChannels"]):
                grey = grey_levels(np.stack([np.frombuffer(d, np.uint8) for d in rows["data"]]).reshape(-1, int(h), int(w), int(c)))
                out.loc[rows.index, "p_hash"] = hashes(grey)
                out.loc[rows.index, "mean"] = grey.reshape(len(grey), -1).mean(axis=1)
                out.loc[rows.index, "entropy"] = _entropy(grey)
            yield out.astype({"mean": "float64", "entropy": "float64"})

    fields = [F.col(image)[c].alias(c) for c in ("origin", "height", "width", "nChannels", "mode", "data")]
    return images.select(*fields).mapInPandas(run, OUT)
