"""Pixel digests and sizes of pictures (SRC09, SCL41, SCL42, SCL45-47)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rgb(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """Spark's image data (blue first, perhaps alpha) as red, green, blue."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def pixel_digest(pixels: np.ndarray) -> str:
    """SCL41: digest of the size and the RGB bytes."""
    height, width = pixels.shape[:2]
    return hashlib.sha256(f"{width}x{height}:".encode() + np.ascontiguousarray(pixels).tobytes()).hexdigest()


def _taps(size: int, out: int, reach: float = 3.0) -> np.ndarray:
    """Weights of a Lanczos resampling from ``size`` to ``out`` samples."""
    scale = max(1.0, size / out)
    x = ((np.arange(out) + 0.5) * size / out)[:, None] - (np.arange(size) + 0.5)[None, :]
    x = x / scale
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def difference_hash(pixels: np.ndarray) -> str:
    """SCL42: 64 bits, bit y * 8 + x set where brightness falls from column x to x + 1 of the picture at 9 by 8."""
    grey = np.rint(pixels @ np.array([0.299, 0.587, 0.114]))
    small = np.clip(np.rint(_taps(grey.shape[0], 8) @ grey @ _taps(grey.shape[1], 9).T), 0, 255)
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    return f"{sum(1 << i for i, b in enumerate(bits) if b):016x}"


@F.pandas_udf(T.StructType([T.StructField("pixel_sha256", T.StringType()), T.StructField("dhash", T.StringType())]))
def digests_of(image: pd.DataFrame) -> pd.DataFrame:
    """Both digests of an image struct; NULL for a picture that couldn't be decoded."""
    out = []
    for w, h, c, d in zip(image["width"], image["height"], image["nChannels"], image["data"], strict=True):
        if w is None or pd.isna(w) or w <= 0 or not d:
            out.append((None, None))
            continue
        pixels = rgb(int(w), int(h), int(c), bytes(d))
        out.append((pixel_digest(pixels), difference_hash(pixels)))
    return pd.DataFrame(out, columns=["pixel_sha256", "dhash"])


def half_size(width: Column, height: Column) -> Column:
    """SCL46: half of each side, rounded down, at least 1."""
    return F.array(F.greatest(F.lit(1), F.floor(width / 2)), F.greatest(F.lit(1), F.floor(height / 2)))


def within_budget(width: Column, height: Column, most_pixels: int) -> Column:
    """SCL45: the size scaled down, if need be, to at most so many pixels; sides at least 1."""
    factor = F.least(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height)))
    return F.array(F.greatest(F.lit(1), F.floor(width * factor)), F.greatest(F.lit(1), F.floor(height * factor)))


def padded_size(width: Column, height: Column, aspect: int = 100) -> Column:
    """SCL47: the size with the short side padded so that neither is more than ``aspect`` times the other."""
    return F.array(F.greatest(width, F.ceil(height / aspect)), F.greatest(height, F.ceil(width / aspect)))


def fit_sizes(sizes: list[tuple[int, int]], tokens_of, budget: int, rounds: int = 32) -> list[tuple[int, int]] | None:
    """SCL48: shrink the largest picture, by a fraction between .4 and .75 a round, until the tokens fit; None if they don't."""
    sizes = list(sizes)
    for _ in range(rounds):
        total = sum(map(tokens_of, sizes))
        if total <= budget:
            return sizes
        i = max(range(len(sizes)), key=lambda j: sizes[j][0] * sizes[j][1])
        own = tokens_of(sizes[i])
        area = min(0.75, max(0.4, (own - (total - budget)) / own if own else 0.4))
        sizes[i] = tuple(max(1, math.floor(side * math.sqrt(area))) for side in sizes[i])
    return None


def vision_tokens(grid: Column, merge: int = 2) -> Column:
    """SCL49: tokens of a grid (t, h, w) of patches."""
    return F.floor(F.aggregate(grid, F.lit(1).cast("bigint"), lambda a, v: a * v) / (merge * merge))
