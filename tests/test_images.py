import numpy as np

from quartzframe.images import kernels


def test_levels_letterbox_and_mask():
    image = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert (kernels.levels(image) == image).all() and kernels.levels(image, shadow=10, highlight=20).max() == 255
    boxed, scale, left, top = kernels.letterbox(np.zeros((10, 20, 3), np.uint8), 40)
    assert boxed.shape == (40, 40, 3) and (scale, left, top) == (2.0, 0, 10) and boxed[0, 0, 0] == 128
    assert kernels.from_letterbox([[40, 30]], scale, left, top).tolist() == [[20.0, 10.0]]
    assert kernels.fill_quad(10, 10, np.array([(2, 2), (6, 2), (6, 5), (2, 5)])).sum() == 20
    assert kernels.gradient(np.tile(np.arange(8.0), (8, 1)))[4, 4] == 8
    mean, std, n = kernels.border_stats(np.full((20, 20, 3), 7, np.uint8))
    assert mean.tolist() == [7, 7, 7] and n == 76


def test_a_failed_image_is_a_row(spark):
    files = spark.createDataFrame([("a", bytearray(b"\x05" * 4)), ("b", bytearray(b"xx"))], "image_id string, content binary")
    decode = lambda raw: np.frombuffer(raw, np.uint8).reshape(2, 2)
    got = {r["image_id"]: (r["status"], r["mean"]) for r in kernels.map_images(files, decode, lambda x: {"mean": float(x.mean())}, "mean double").collect()}
    assert got == {"a": ("success", 5.0), "b": ("error", None)}


def test_flat_stretch_keeps_values():
    flat = np.full((3, 3), 9, np.uint8)
    assert (kernels.percentile_stretch(flat) == flat).all()
    assert kernels.stretch(np.array([0, 50, 100], np.uint8), 0, 100).tolist() == [0, 127, 255]
