"""Registered queries of rasters, each with the SQL that gives the same rows: a vector of 64 values is a picture of 8 by 8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..images import kernels, rasters
from .queries import register, table

SIDE = 8
#: Corners before each is moved by a vector's values.
FRAME = (1, 1, 6, 1, 6, 5, 1, 5)


def _decoded(raw: bytes) -> np.ndarray:
    return np.array([float(v) for v in raw.decode().split(",")]).reshape(SIDE, SIDE)


def _pictures(spark: SparkSession, d: str, value) -> DataFrame:
    text = F.array_join(F.transform("embedding", lambda v: value(v.cast("double")).cast("string")), ",")
    return table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("image_id"), F.encode(text, "utf-8").alias("content"), "embedding")


@register(
    "border_regions",
    f"""WITH RECURSIVE m AS (SELECT vec_id, i, i // {SIDE} AS r, i % {SIDE} AS c FROM embeddings, range({SIDE * SIDE}) AS t(i) WHERE embedding[i + 1] > 0.05),
    f AS (SELECT * FROM m WHERE r IN (0, {SIDE - 1}) OR c IN (0, {SIDE - 1}) UNION SELECT m.* FROM f JOIN m ON m.vec_id = f.vec_id AND abs(m.r - f.r) <= 1 AND abs(m.c - f.c) <= 1)
    SELECT e.vec_id, (SELECT count(*) FROM m WHERE m.vec_id = e.vec_id) AS n, coalesce(k.n, 0) AS kept, coalesce(k.cells, '') AS cells FROM embeddings e LEFT JOIN (SELECT vec_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS cells FROM f GROUP BY 1) k USING (vec_id)""",
)
def border_regions(spark: SparkSession, d: str) -> DataFrame:
    """The pixels above a threshold that hold together with the border of their picture."""

    def kernel(mask: np.ndarray) -> dict:
        kept = np.nonzero(rasters.border_connected(mask).ravel())[0]
        return {"n": int(mask.sum()), "kept": len(kept), "cells": ",".join(map(str, kept))}

    files = _pictures(spark, d, lambda v: (v > 0.05).cast("int"))
    return kernels.map_images(files, _decoded, kernel, "n long, kept long, cells string").select(F.col("image_id").cast("long").alias("vec_id"), "n", "kept", "cells")


def _upright_sql() -> str:
    xy = [f"{FRAME[k]} + embedding[{k + 1}]::DOUBLE * 4 AS {'xy'[k % 2]}{k // 2}" for k in range(8)]
    pick = lambda how, key: ", ".join(f"{how}({v}, {key}) AS {v}" for v in "xy")
    side = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
    at = lambda dx, dy: f"CASE WHEN l + {dx} BETWEEN 0 AND {SIDE - 1} AND t + {dy} BETWEEN 0 AND {SIDE - 1} THEN p[(t + {dy}) * {SIDE} + l + {dx} + 1] * (1 - abs(x - l - {dx})) * (1 - abs(y - t - {dy})) ELSE 0 END"
    return f"""WITH v AS (SELECT vec_id, [floor(abs(z::DOUBLE) * 1000) for z in embedding] AS p, {", ".join(xy)} FROM embeddings),
    c AS (SELECT vec_id, unnest([{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x3, 'y': y3}}]) AS c FROM v),
    o AS (SELECT vec_id, arg_min(c, c.x + c.y) AS a, arg_max(c, c.x - c.y) AS b, arg_max(c, c.x + c.y) AS c, arg_min(c, c.x - c.y) AS d FROM c GROUP BY 1),
    s AS (SELECT *, floor(greatest({side("a", "b")}, {side("c", "d")}))::BIGINT AS w, floor(greatest({side("b", "c")}, {side("d", "a")}))::BIGINT AS h FROM o),
    q AS (SELECT *, a.x - b.x + c.x - d.x AS sx, a.y - b.y + c.y - d.y AS sy, (b.x - c.x) * (d.y - c.y) - (d.x - c.x) * (b.y - c.y) AS den FROM s WHERE w >= 2 AND h >= 2),
    m AS (SELECT *, (sx * (d.y - c.y) - (d.x - c.x) * sy) / den AS g, ((b.x - c.x) * sy - sx * (b.y - c.y)) / den AS k FROM q),
    px AS (SELECT vec_id, w, i::DOUBLE / (w - 1) AS u, j::DOUBLE / (h - 1) AS r, i, j, a, b, d, g, k FROM m, range(64) AS t(i), range(64) AS z(j) WHERE i < w AND j < h),
    xy AS (SELECT vec_id, i, j, w, ((b.x - a.x + g * b.x) * u + (d.x - a.x + k * d.x) * r + a.x) / (g * u + k * r + 1) AS x, ((b.y - a.y + g * b.y) * u + (d.y - a.y + k * d.y) * r + a.y) / (g * u + k * r + 1) AS y FROM px),
    n AS (SELECT xy.*, p, floor(x)::BIGINT AS l, floor(y)::BIGINT AS t FROM xy JOIN v USING (vec_id)),
    f AS (SELECT vec_id, sum(z) AS total, sum(z * (j * w + i + 1)) AS weighted FROM (SELECT *, {at(0, 0)} + {at(1, 0)} + {at(0, 1)} + {at(1, 1)} AS z FROM n) GROUP BY 1)
    SELECT vec_id, CASE WHEN f.total IS NULL THEN 'error' ELSE 'success' END AS status, CASE WHEN f.total IS NOT NULL THEN w END::INTEGER AS width, CASE WHEN f.total IS NOT NULL THEN h END::INTEGER AS height, round(total, 4) + 0.0::DOUBLE AS total, round(weighted, 3) + 0.0::DOUBLE AS weighted FROM s LEFT JOIN f USING (vec_id)"""


@register("upright_pictures", _upright_sql())
def upright_pictures(spark: SparkSession, d: str) -> DataFrame:
    """A quad of each picture made upright: size, sum and sum by place of its pixels."""

    def kernel(image: np.ndarray, corners) -> dict:
        picture = rasters.upright(image, np.array(list(corners)).reshape(4, 2))
        places = np.arange(1, picture.size + 1).reshape(picture.shape)
        return {"width": picture.shape[1], "height": picture.shape[0], "total": float(picture.sum()), "weighted": float((picture * places).sum())}

    corners = F.array(*[F.element_at("embedding", k + 1).cast("double") * 4 + FRAME[k] for k in range(8)])
    files = _pictures(spark, d, lambda v: F.floor(F.abs(v) * 1000)).withColumn("corners", corners)
    made = kernels.map_images(files, _decoded, kernel, "width int, height int, total double, weighted double", ["corners"])
    return made.select(F.col("image_id").cast("long").alias("vec_id"), "status", "width", "height", (F.round("total", 4) + 0.0).alias("total"), (F.round("weighted", 3) + 0.0).alias("weighted"))
