"""Border regions against a flood fill, upright pictures against a pixel by pixel computation."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzframe.images import rasters


def flooded(mask):
    height, width = mask.shape
    out = np.zeros(mask.shape, np.uint8)
    stack = [(r, c) for r in range(height) for c in range(width) if mask[r, c] and (r in (0, height - 1) or c in (0, width - 1))]
    while stack:
        r, c = stack.pop()
        if 0 <= r < height and 0 <= c < width and mask[r, c] and not out[r, c]:
            out[r, c] = 1
            stack += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@given(st.integers(1, 12), st.integers(1, 12), st.floats(0, 1), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_border_regions_equal_a_flood_fill(height, width, share, seed):
    mask = np.random.default_rng(seed).random((height, width)) < share
    assert (rasters.border_connected(mask) == flooded(mask)).all()


def test_spirals_corners_and_empty_rasters():
    for shape in ((0, 0), (0, 5), (5, 0)):
        assert rasters.border_connected(np.zeros(shape, bool)).shape == shape
    assert not rasters.border_connected(np.zeros((4, 4), bool)).any()
    diagonal = np.eye(50, dtype=bool)
    assert (rasters.border_connected(diagonal) == diagonal).all()
    comb = np.zeros((60, 601), np.uint8)
    comb[1:-1, 1:-1:2] = 1
    assert not rasters.border_connected(comb).any()
    comb[58, 1:] = 1
    assert (rasters.border_connected(comb) == comb).all()


def by_pixel(image, quad, width, height):
    """The closed form of the map from a unit square, and the four neighbours of each point."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    den = (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)
    g, h = (sx * (y3 - y2) - (x3 - x2) * sy) / den, ((x1 - x2) * sy - sx * (y1 - y2)) / den
    out = np.zeros((height, width))
    for j in range(height):
        for i in range(width):
            u, v = i / (width - 1), j / (height - 1)
            w = g * u + h * v + 1
            x, y = ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / w, ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / w
            left, top = int(np.floor(x)), int(np.floor(y))
            for a, b in ((left, top), (left + 1, top), (left, top + 1), (left + 1, top + 1)):
                if 0 <= a < image.shape[1] and 0 <= b < image.shape[0]:
                    out[j, i] += image[b, a] * (1 - abs(x - a)) * (1 - abs(y - b))
    return out


@pytest.mark.parametrize("block", [1, 50, 1 << 18])
def test_upright_equals_the_pixel_by_pixel_map(block):
    r = np.random.default_rng(3)
    image = r.random((40, 60))
    for _ in range(5):
        quad = np.array([(5, 6), (50, 4), (55, 36), (3, 33)]) + r.uniform(-7, 7, (4, 2))
        got = rasters.upright(image, r.permutation(quad), block)
        width, height = rasters.upright_size(rasters.by_sums(quad))
        assert got.shape == (height, width)
        assert np.abs(got - by_pixel(image, rasters.by_sums(quad), width, height)).max() < 1e-9


def test_an_upright_frame_is_a_cut():
    image = np.random.default_rng(0).integers(0, 256, (20, 30, 3), np.uint8)
    got = rasters.upright(image, [(4, 3), (14, 3), (14, 11), (4, 11)])
    # ten pixels stretched over the eleven centres from 4 to 14
    assert got.shape == (8, 10, 3) and got.dtype == np.uint8
    assert (got[0, 0] == image[3, 4]).all() and (got[-1, -1] == image[11, 14]).all()


def test_corners_that_span_nothing_are_refused():
    image = np.zeros((9, 9), np.uint8)
    for bad in ([(1, 1)] * 4, [(0, 0), (5, 0), (5, 1), (0, 1)], [(0, 0), (1, 1), (2, 2), (3, 3)], [(0, 0), (5, 0), (5, 5)], [(0, 0), (5, 0), (5, 5), (0, float("nan"))]):
        with pytest.raises(ValueError):
            rasters.upright(image, bad)


def test_upright_images_keep_failures_as_rows(spark):
    files = spark.createDataFrame(
        [("a", bytearray(range(64)), [[1, 1], [6, 1], [6, 6], [1, 6]]), ("b", bytearray(range(64)), [[1, 1]] * 4), ("c", None, [[1, 1], [6, 1], [6, 6], [1, 6]]), ("d", bytearray(range(64)), None)],
        "image_id string, content binary, corners array<array<int>>",
    )
    got = {r["image_id"]: r for r in rasters.upright_images(files, lambda raw: np.frombuffer(raw, np.uint8).reshape(8, 8), lambda a: a.tobytes()).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "success", "b": "error", "c": "error", "d": "error"}
    assert (got["a"]["width"], got["a"]["height"]) == (5, 5) and got["a"]["picture"][0] == 9 and got["a"]["picture"][-1] == 54
    assert got["b"]["reason"] == "ValueError" and got["b"]["picture"] is None
