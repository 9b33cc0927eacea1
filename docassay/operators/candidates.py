"""Seal candidates of page rasters, whatever their colour: darker than their surroundings, compact, inked around a rim.

One raster gives an array of candidate rows; geometry.semantics and geometry.best_of_page judge them in SQL.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.operators import geometry, pixels

# The longest side that is looked at, from which share of inked pixels a line of the page is a rule, limits of
# a group of ink (lengths in shares of the page's shorter side, areas of the page) and of what is inside it.
LONGEST, RULE = 900, 0.22
GROUP = {"width": (0.035, 0.34), "height": (0.035, 0.34), "aspect": (0.45, 2.22), "area": (0.0008, 0.085), "fill": (0.035, 0.92)}
INSIDE = {"ink": (0.018, 0.58), "ring": (0.018, 1.0), "coverage": (0.28, 1.0)}
# What each part adds to the score, and the least score.
WEIGHTS = {"shape": 0.24, "coverage": 0.34, "ring": 0.22, "contrast": 0.12, "size": 0.08}
LEAST_SCORE = 0.43

NUMBERS = ("score", "ink", "ring", "coverage", "uniformity", "center", "edge_contrast", "texture", "halftone", "saturation")
PLACES = ("x0", "y0", "x1", "y1", "page_width", "page_height")
ROWS = T.ArrayType(T.StructType([T.StructField("candidate", T.IntegerType()), *(T.StructField(n, T.IntegerType()) for n in PLACES), *(T.StructField(n, T.DoubleType()) for n in NUMBERS)]))


def smoothed(plane: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """Means over windows of odd widths, one after the other; at the border the window is what is inside."""
    for width in widths:
        for axis in (0, 1):
            n, half = plane.shape[axis], width // 2
            sums = np.concatenate([np.zeros_like(plane.take([0], axis)), np.cumsum(plane, axis=axis)], axis=axis)
            low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
            size = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
            plane = (sums.take(high, axis) - sums.take(low, axis)) / size
    return plane


def spread(mask: np.ndarray, width: int) -> np.ndarray:
    """Places that have a marked one within a square window."""
    return near(near(mask, width, 0), width, 1)


def near(mask: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Places that have a marked one within a window along an axis."""
    n, half = mask.shape[axis], width // 2
    sums = np.concatenate([np.zeros_like(mask.take([0], axis), dtype=np.int32), np.cumsum(mask, axis=axis, dtype=np.int32)], axis=axis)
    return sums.take(np.minimum(np.arange(n) + half + 1, n), axis) > sums.take(np.maximum(np.arange(n) - half, 0), axis)


def keeps(measures: dict[str, float], limits: dict[str, tuple[float, float]]) -> bool:
    return all(low <= measures[name] <= high for name, (low, high) in limits.items())


def find(rgb: np.ndarray) -> list[dict]:
    """Candidates of one page, in the order of their place."""
    rgb = pixels.shrunk(rgb, LONGEST)
    plane = pixels.grey(rgb)
    h, w = plane.shape
    if min(h, w) < 16:
        return []
    strength = np.clip(smoothed(plane, (17, 15, 17)) - plane, 0, 255)
    felt = strength[strength > 2]
    ink = strength >= max(8.0, min(30.0, float(np.percentile(felt, 58)) if felt.size else 0.0))
    # Rules of tables would join a seal to the whole page.
    rules = near(ink.mean(axis=1, keepdims=True) >= RULE, 5, 0) | near(ink.mean(axis=0, keepdims=True) >= RULE, 5, 1)
    grouped = ~spread(~spread(ink & ~rules, 9), 5)
    edge = pixels.edges(plane)
    fine = np.abs(plane - smoothed(plane, (3,)))
    top = rgb[..., :3].max(axis=2).astype(float)
    saturation = np.where(top > 0, (top - rgb[..., :3].min(axis=2)) / np.maximum(top, 1), 0.0)
    short, out = min(h, w), []
    for count, y0, x0, y1, x1 in sorted(pixels.components(grouped, diagonal=True), key=lambda c: c[1:]):
        bw, bh = x1 - x0, y1 - y0
        if not keeps({"width": bw / short, "height": bh / short, "aspect": bw / bh, "area": bw * bh / (h * w), "fill": count / (bw * bh)}, GROUP):
            continue
        px, py = max(2, round(bw * 0.08)), max(2, round(bh * 0.08))
        ax0, ay0, ax1, ay1 = max(0, x0 - px), max(0, y0 - py), min(w, x1 + px), min(h, y1 + py)
        part = slice(ay0, ay1), slice(ax0, ax1)
        own = ink[part]
        measures = {"ink": float(own.mean()), **pixels.ring_features(own)}
        if not keeps(measures, INSIDE):
            continue
        inked = lambda values, part=part, own=own: values[part][own]
        contrast, size = float(inked(strength).mean()), max(bw, bh) / short
        parts = {
            "shape": max(0.0, 1 - abs(math.log(bw / bh)) / math.log(2)),
            "coverage": measures["coverage"],
            "ring": min(1.0, measures["ring"] / 0.11),
            "contrast": min(1.0, contrast / 38),
            "size": max(0.0, 1 - abs(size - 0.13) / 0.13),
        }
        score = sum(WEIGHTS[name] * value for name, value in parts.items())
        if score < LEAST_SCORE:
            continue
        middle = float(((inked(plane) > 35) & (inked(plane) < 220)).mean())
        more = {"edge_contrast": float(inked(edge).mean()), "texture": float(inked(plane).std()), "halftone": min(1.0, middle * min(1.0, float(inked(fine).mean()) / 12)), "saturation": float(inked(saturation).mean())}
        out.append({"candidate": len(out), "x0": ax0, "y0": ay0, "x1": ax1, "y1": ay1, "page_width": w, "page_height": h, "score": score, **measures, **more})
    return out


@F.pandas_udf(ROWS)
def seal_candidates(rasters: pd.DataFrame) -> pd.Series:
    """Candidates of each raster; an absent or empty one has none."""
    sizes = zip(rasters["h"], rasters["w"], rasters["c"], rasters["data"], strict=True)
    return pd.Series([find(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c))) if data is not None and len(data) and c >= 3 else [] for h, w, c, data in sizes])


def best_candidates(pages: DataFrame, keys: list[str], raster: str = "raster") -> DataFrame:
    """The best candidate of each page that has any, judged by its geometry."""
    rows = pages.select(*keys, F.explode(seal_candidates(raster)).alias("c")).select(*keys, "c.*")
    return geometry.best_of_page(geometry.semantics(rows), keys)
