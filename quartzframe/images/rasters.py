"""Regions of a mask that touch its border, and a quad of a picture made upright; NumPy behind the per-image stage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .kernels import map_images

#: Pixels of the upright picture that are computed at once.
BLOCK = 1 << 18


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and the column after the last of each run of a mask, in reading order."""
    edges = np.diff(np.pad(mask.astype(bool), ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    return row, start, np.nonzero(edges == -1)[1]


def run_labels(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The first run of each run's region; regions hold together over sides and corners of pixels."""
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # runs of the next row that meet a run, corners included: a range of runs, found on rows laid end to end
    wide = width + 2
    first = np.searchsorted(row * wide + end, (row + 1) * wide + start)
    last = np.searchsorted(row * wide + start, (row + 1) * wide + end, side="right")
    for i in np.nonzero(last > first)[0].tolist():
        for j in range(first[i], last[i]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(row))], dtype=np.int64)


def border_connected(mask: np.ndarray) -> np.ndarray:
    """The part of a mask (0 or 1) in regions that touch the border of the raster; regions hold together over corners too.

    Union of runs: what is kept in Python is two numbers a run. A raster without pixels gives itself.
    """
    height, width = mask.shape
    row, start, end = runs(mask)
    label = run_labels(row, start, end, width)
    outer = (row == 0) | (row == height - 1) | (start == 0) | (end == width)
    kept = np.isin(label, label[outer])
    steps = np.zeros((height, width + 1), np.int8)
    steps[row[kept], start[kept]] = 1
    steps[row[kept], end[kept]] -= 1
    return np.cumsum(steps, axis=1, dtype=np.int8)[:, :width].astype(np.uint8)


def by_sums(corners: np.ndarray) -> np.ndarray:
    """Four corners as top left, top right, bottom right, bottom left: least and largest x + y, largest and least x - y; the first of equal ones."""
    corners = np.asarray(corners, np.float64)
    both, apart = corners.sum(axis=1), corners[:, 0] - corners[:, 1]
    return corners[[both.argmin(), apart.argmax(), both.argmax(), apart.argmin()]]


def upright_size(quad: np.ndarray) -> tuple[int, int]:
    """Whole width and height of the upright picture: the longer of each two opposite sides."""
    side = np.hypot(*(quad - np.roll(quad, -1, axis=0)).T)
    return int(max(side[0], side[2])), int(max(side[1], side[3]))


def rectangle_map(quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The 3 x 3 matrix that takes the outer pixel centres of a rectangle to the corners of a quad."""
    system, goal = [], []
    for (u, v), (x, y) in zip(((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)), quad, strict=True):
        system += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        goal += [x, y]
    try:
        return np.append(np.linalg.solve(np.array(system, np.float64), goal), 1.0).reshape(3, 3)
    except np.linalg.LinAlgError as error:
        raise ValueError("the corners don't span a picture") from error


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at points; what lies outside of the image is 0."""
    height, width = image.shape[:2]
    left, top = np.floor(x), np.floor(y)
    out = np.zeros((*x.shape, *image.shape[2:]), np.float64)
    for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        column, line = left + dx, top + dy
        inside = (column >= 0) & (column < width) & (line >= 0) & (line < height)
        weight = np.where(inside, (1 - np.abs(x - column)) * (1 - np.abs(y - line)), 0.0)
        found = image[np.where(inside, line, 0).astype(np.int64), np.where(inside, column, 0).astype(np.int64)]
        out += found * weight.reshape(*weight.shape, *(1,) * (image.ndim - 2))
    return out


def upright(image: np.ndarray, corners: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The quad of a picture as an upright one: each pixel is looked up where the map of its rectangle puts it.

    Rows are computed in blocks of about ``block`` pixels, so that no more than a block's coordinates are held beside the two pictures. Whole
    number types are rounded. Corners that aren't four finite points, or span less than two pixels, raise ValueError.
    """
    corners = np.asarray(corners, np.float64)
    if corners.shape != (4, 2) or not np.isfinite(corners).all():
        raise ValueError("four finite corners are needed")
    quad = by_sums(corners)
    width, height = upright_size(quad)
    if min(width, height) < 2:
        raise ValueError("the corners don't span a picture")
    m = rectangle_map(quad, width, height)
    out = np.empty((height, width, *image.shape[2:]), image.dtype)
    rows = max(1, block // width)
    u = np.arange(width, dtype=np.float64)
    for begin in range(0, height, rows):
        v = np.arange(begin, min(height, begin + rows), dtype=np.float64)[:, None]
        deep = m[2, 0] * u + m[2, 1] * v + m[2, 2]
        # a point at infinity lies outside
        deep = np.where(deep == 0, np.nan, deep)
        x, y = (np.nan_to_num((m[i, 0] * u + m[i, 1] * v + m[i, 2]) / deep, nan=-2.0) for i in (0, 1))
        values = sampled(image, x, y)
        out[begin : begin + rows] = np.rint(values) if np.issubdtype(image.dtype, np.integer) else values
    return out


def upright_images(files: DataFrame, decode: Callable[[bytes], np.ndarray], encode: Callable[[np.ndarray], bytes], corners: str = "corners") -> DataFrame:
    """Rows (image_id, status, reason, width, height, picture) of files (image_id, content, corners: array of x and y); a failed image is a row."""

    def made(image: np.ndarray, points) -> dict:
        picture = upright(image, np.array([list(p) for p in points], np.float64))
        return {"width": picture.shape[1], "height": picture.shape[0], "picture": encode(picture)}

    return map_images(files, decode, made, "width int, height int, picture binary", [corners])
