"""Pixel statistics as Arrow UDFs over rasters: struct<h int, w int, c int, data binary>, bytes by row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RASTER = "struct<h:int,w:int,c:int,data:binary>"
STATS = T.StructType([T.StructField(n, T.IntegerType() if n == "red_count" else T.DoubleType()) for n in ("block_variance", "edge", "red", "red_count", "red_max_ratio", "edge_contrast", "color_std", "noise_peak_ratio")])


def image(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], row["c"])


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if rgb.shape[2] >= 3 else rgb[..., 0].astype(np.float64)


def block_deviations(plane: np.ndarray, size: int = 16) -> np.ndarray:
    h, w = (n // size * size for n in plane.shape)
    return plane[:h, :w].reshape(h // size, size, w // size, size).std(axis=(1, 3)) if h and w else np.zeros((0, 0))


def edges(plane: np.ndarray) -> np.ndarray:
    """Absolute response of the eight-neighbour Laplacian; the border is 0."""
    out = np.zeros_like(plane)
    if min(plane.shape) > 2:
        total = sum(plane[1 + dy : plane.shape[0] - 1 + dy, 1 + dx : plane.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = np.abs(9 * plane[1:-1, 1:-1] - total)
    return np.minimum(out, 255)


def components(mask: np.ndarray, diagonal: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(pixels, y0, x0, y1, x1) of the connected parts, by joining runs of neighbouring rows."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    before: list[tuple[int, int, int]] = []
    reach = 1 if diagonal else 0
    for y in range(mask.shape[0]):
        steps = np.diff(np.r_[0, mask[y].astype(np.int8), 0])
        own = []
        for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            boxes.append([b - a, y, a, y + 1, b])
            for c, d, j in before:
                if c < b + reach and a < d + reach:
                    p, q = sorted((find(j), find(k)))
                    if p != q:
                        parent[q] = p
                        m, n = boxes[p], boxes[q]
                        boxes[p] = [m[0] + n[0], min(m[1], n[1]), min(m[2], n[2]), max(m[3], n[3]), max(m[4], n[4])]
            own.append((a, b, k))
        before = own
    return [tuple(boxes[k]) for k in range(len(parent)) if find(k) == k]


def page_statistics(rgb: np.ndarray) -> dict[str, float]:
    plane = grey(rgb)
    deviations, edge = block_deviations(plane), edges(plane)
    out = {"block_variance": float(deviations.std()) if deviations.size else 0.0, "edge": float(edge.mean()), "red": 0.0, "red_count": 0, "red_max_ratio": 0.0, "edge_contrast": 0.0, "color_std": 0.0}
    if rgb.shape[2] >= 3:
        r, g, b = (rgb[..., k].astype(np.int16) for k in range(3))
        mask = (r > 120) & (r - g > 35) & (r - b > 35)
        parts = [p for p in components(mask) if p[0] >= 20]
        out["red"] = float(mask.mean())
        out["red_count"] = len(parts)
        if parts:
            n, y0, x0, y1, x1 = max(parts)
            inside = mask[y0:y1, x0:x1]
            out |= {"red_max_ratio": n / mask.size, "edge_contrast": float(edge[y0:y1, x0:x1][inside].mean()), "color_std": float(rgb[y0:y1, x0:x1][inside].astype(np.float64).std(axis=0).mean())}
    # Noise: what a 3x3 median leaves, by block, its peak over its middle.
    if min(plane.shape) > 2:
        shifted = np.stack([plane[1 + dy : plane.shape[0] - 1 + dy, 1 + dx : plane.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        noise = block_deviations(plane[1:-1, 1:-1] - np.median(shifted, axis=0), 32)
        out["noise_peak_ratio"] = float(np.percentile(noise, 99) / max(float(np.median(noise)), 1e-6)) if noise.size else 0.0
    else:
        out["noise_peak_ratio"] = 0.0
    return out


@F.pandas_udf(STATS)
def raster_statistics(rasters: pd.DataFrame) -> pd.DataFrame:
    """Statistics of each raster; an absent or empty one has zeros."""
    zero = {"block_variance": 0.0, "edge": 0.0, "red": 0.0, "red_count": 0, "red_max_ratio": 0.0, "edge_contrast": 0.0, "color_std": 0.0, "noise_peak_ratio": 0.0}
    return pd.DataFrame([page_statistics(image(dict(zip("hwc", size, strict=True)) | {"data": data})) if data is not None and len(data) else zero for *size, data in zip(rasters["h"], rasters["w"], rasters["c"], rasters["data"], strict=True)], columns=[*zero])


def dhash(plane: np.ndarray) -> int:
    """64-bit difference hash of an 8 x 9 reduction by area means."""
    ys, xs = np.linspace(0, plane.shape[0], 9).astype(int), np.linspace(0, plane.shape[1], 10).astype(int)
    small = np.array([[plane[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)].mean() for j in range(9)] for i in range(8)])
    return int("".join("1" if small[i, j + 1] > small[i, j] else "0" for i in range(8) for j in range(8)), 2)


def polar(plane: np.ndarray, height: int = 64, width: int = 256) -> np.ndarray:
    """A disc unrolled: rows from the rim inwards, columns by angle."""
    cy, cx = (plane.shape[0] - 1) / 2, (plane.shape[1] - 1) / 2
    radius = np.linspace(1, 0.3, height)[:, None] * min(cy, cx)
    angle = np.linspace(0, 2 * np.pi, width, endpoint=False)[None, :]
    return plane[np.clip(np.round(cy + radius * np.sin(angle)).astype(int), 0, plane.shape[0] - 1), np.clip(np.round(cx + radius * np.cos(angle)).astype(int), 0, plane.shape[1] - 1)]


def ring_features(mask: np.ndarray, sectors: int = 24) -> dict[str, float]:
    """Ink on the rim and in the middle of a box, and how evenly the rim is inked around."""
    h, w = mask.shape
    y, x = np.mgrid[0:h, 0:w]
    dy, dx = (y - (h - 1) / 2) / max(h / 2, 1), (x - (w - 1) / 2) / max(w / 2, 1)
    r = np.sqrt(dy * dy + dx * dx)
    rim, middle = (r >= 0.62) & (r <= 1.02), r <= 0.52
    if min(h, w) < 8 or not rim.any():
        return {"ring": 0.0, "center": 0.0, "coverage": 0.0, "uniformity": 0.0}
    part = np.minimum(((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * sectors).astype(int), sectors)
    inked, size = np.bincount(part[rim & mask], minlength=sectors + 1)[:sectors], np.bincount(part[rim], minlength=sectors + 1)[:sectors]
    share = inked / np.maximum(size, 1)
    held = share[share >= 0.018]
    even = 1 / (1 + held.std() / max(held.mean(), 1e-6)) if len(held) >= 4 else 0.0
    return {"ring": float(mask[rim].mean()), "center": float(mask[middle].mean()), "coverage": len(held) / sectors, "uniformity": float(even)}


def resized(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """A raster in other dimensions: area means where it shrinks, the nearest pixel where it grows."""
    ys, xs = np.linspace(0, rgb.shape[0], height + 1), np.linspace(0, rgb.shape[1], width + 1)
    if height >= rgb.shape[0] and width >= rgb.shape[1]:
        return rgb[np.minimum(ys[:-1].astype(int), rgb.shape[0] - 1)][:, np.minimum(xs[:-1].astype(int), rgb.shape[1] - 1)]
    rows, columns = ys[:-1].astype(int), xs[:-1].astype(int)
    sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.float64), rows, axis=0), columns, axis=1)
    sizes = np.diff(np.r_[rows, rgb.shape[0]])[:, None] * np.diff(np.r_[columns, rgb.shape[1]])[None, :]
    return np.round(sums / sizes[..., None]).astype(np.uint8)


def shrunk(rgb: np.ndarray, most: int) -> np.ndarray:
    """A raster whose longer side is at most so many pixels."""
    scale = min(most / max(rgb.shape[:2]), 1.0)
    return rgb if scale >= 1 else resized(rgb, max(1, int(rgb.shape[0] * scale)), max(1, int(rgb.shape[1] * scale)))


def context_crop(rgb: np.ndarray, x0: float, y0: float, x1: float, y1: float, pad: float = 0.20) -> np.ndarray:
    """The part within a box of shares of the page, with a fifth of its longer side around it."""
    h, w = rgb.shape[:2]
    left, top, right, bottom = x0 * w, y0 * h, x1 * w, y1 * h
    more = pad * max(right - left, bottom - top)
    return rgb[max(0, int(top - more)) : min(h, math.ceil(bottom + more)), max(0, int(left - more)) : min(w, math.ceil(right + more))]


def reading_crop(rgb: np.ndarray, x0: float, y0: float, x1: float, y1: float, least: int = 640) -> np.ndarray:
    """The grey context crop with its contrast stretched between the first and the last hundredth, grown to a recogniser's size."""
    plane = grey(context_crop(rgb, x0, y0, x1, y1))
    if not plane.size:
        return plane.astype(np.uint8)
    low, high = np.percentile(plane, (1, 99))
    plane = np.clip((plane - low) / max(high - low, 1e-6) * 255, 0, 255).astype(np.uint8)
    scale = max(1.0, least / max(plane.shape))
    return resized(plane[..., None], int(plane.shape[0] * scale), int(plane.shape[1] * scale))[..., 0] if scale > 1 else plane


@F.pandas_udf(T.StructType([*(T.StructField(n, T.IntegerType()) for n in "hwc"), T.StructField("data", T.BinaryType())]))
def cropped(rasters: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    """Context crops of rasters by boxes (struct x0, y0, x1, y1); an absent raster or box has none."""
    out = []
    for h, w, c, data, *box in zip(rasters["h"], rasters["w"], rasters["c"], rasters["data"], *(boxes[k] for k in ("x0", "y0", "x1", "y1")), strict=True):
        if data is None or any(pd.isna(b) for b in box):
            out.append((0, 0, 0, None))
        else:
            part = context_crop(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)), *box)
            out.append((*part.shape, part.tobytes()))
    return pd.DataFrame(out, columns=["h", "w", "c", "data"])
