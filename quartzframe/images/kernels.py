"""NumPy kernels on height x width x channels arrays, and the stage that applies a kernel to image bytes.

Decoders are passed in, so that a cluster uses the codec it has. Kernels that need a
computer-vision library aren't restated here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def stretch(channel: np.ndarray, low: float, high: float) -> np.ndarray:
    """Linear stretch of the values from ``low`` to ``high`` onto 0 to 255; a flat range leaves the channel as it is."""
    if high <= low:
        return channel.copy()
    return np.clip((channel.astype(np.float64) - low) * 255.0 / (high - low), 0, 255).astype(np.uint8)


def percentile_stretch(channel: np.ndarray, low: float = 5.0, high: float = 95.0) -> np.ndarray:
    return stretch(channel, float(np.percentile(channel, low)), float(np.percentile(channel, high)))


def levels(image: np.ndarray, shadow: int = 0, gamma: float = 1.0, highlight: int = 255) -> np.ndarray:
    """Levels by a table of 256 values."""
    x = np.clip((np.arange(256, dtype=np.float64) - shadow) / max(1, highlight - shadow), 0, 1)
    return np.rint(255 * x ** (1 / gamma)).astype(np.uint8)[image]


def resize_nearest(image: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.minimum((np.arange(height) + 0.5) * image.shape[0] / height, image.shape[0] - 1).astype(int)
    columns = np.minimum((np.arange(width) + 0.5) * image.shape[1] / width, image.shape[1] - 1).astype(int)
    return image[rows[:, None], columns]


def resize_linear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize about pixel centres, edges repeated."""

    def along(size: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    (top, bottom, down), (left, right, across) = along(height, image.shape[0]), along(width, image.shape[1])
    more = (1,) * (image.ndim - 2)
    down, across = down.reshape(-1, 1, *more), across.reshape(1, -1, *more)
    mixed = lambda rows: image[rows][:, left] * (1 - across) + image[rows][:, right] * across
    out = mixed(top) * (1 - down) + mixed(bottom) * down
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out.astype(image.dtype)


def letterbox(image: np.ndarray, width: int, height: int | None = None, fill: int = 128) -> tuple[np.ndarray, float, int, int]:
    """The image inside a frame of ``width`` and ``height`` (none: a square) with its scale and offsets."""
    height = height or width
    scale = min(width / image.shape[1], height / image.shape[0])
    h, w = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    out = np.full((height, width, *image.shape[2:]), fill, image.dtype)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = resize_linear(image, w, h)
    return out, scale, left, top


def from_letterbox(points: np.ndarray, scale: float, left: int, top: int) -> np.ndarray:
    return (np.asarray(points, float) - (left, top)) / scale


def gradient(gray: np.ndarray) -> np.ndarray:
    """Magnitude of the 3 x 3 Sobel responses, edges repeated."""
    p = np.pad(gray.astype(np.float64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy)


def border_stats(image: np.ndarray, share: float = 0.05) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, standard deviation and number of the pixels of the border."""
    h, w = image.shape[:2]
    band = max(1, int(min(h, w) * share))
    mask = np.ones((h, w), bool)
    mask[band : h - band, band : w - band] = False
    pixels = image[mask].reshape(int(mask.sum()), -1).astype(np.float64)
    return pixels.mean(axis=0), pixels.std(axis=0), len(pixels)


def fill_quad(width: int, height: int, quad: np.ndarray) -> np.ndarray:
    """Mask of the pixel centres inside a convex quad."""
    y, x = np.mgrid[0:height, 0:width]
    sides = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(quad, np.roll(quad, -1, axis=0))]
    return np.logical_or(np.all([s >= 0 for s in sides], axis=0), np.all([s <= 0 for s in sides], axis=0))


def clip_polygon(subject: list, clipper: list) -> list:
    """The part of a convex polygon inside another, side by side."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(clipper, clipper[1:] + clipper[:1]))
    sign = 1 if area >= 0 else -1
    for a, b in zip(clipper, clipper[1:] + clipper[:1]):
        side = lambda p, a=a, b=b: sign * ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = out
        if not subject:
            return []
    return subject


def polygon_area(points: list) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2 if points else 0.0


def polygon_iou(a: list, b: list) -> float:
    """Shared area of two convex polygons over their joint area."""
    both = polygon_area(clip_polygon(a, b))
    union = polygon_area(a) + polygon_area(b) - both
    return both / union if union > 0 else 0.0


def map_images(files: DataFrame, decode: Callable[[bytes], np.ndarray], kernel: Callable[..., dict], schema: str, values: Sequence[str] = ()) -> DataFrame:
    """Rows (image_id, status, reason, and the kernel's columns in ``schema``); an image that fails is a row, not an error.

    The kernel is given the decoded image and the row's ``values``.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for image_id, content, *more in zip(*[frame[c] for c in ("image_id", "content", *values)]):
                try:
                    found = kernel(decode(content), *more)
                    rows.append((image_id, "success", None, *[found.get(n) for n in names]))
                except Exception as error:  # noqa: BLE001  one image must not end the job
                    rows.append((image_id, "error", type(error).__name__, *[None] * len(names)))
            yield pd.DataFrame(rows, columns=["image_id", "status", "reason", *names])

    return files.select("image_id", "content", *values).mapInPandas(run, f"image_id string, status string, reason string, {schema}")
