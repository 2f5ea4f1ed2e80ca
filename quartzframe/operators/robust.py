"""Robust line fits over groups of weighted points, from moments that Spark adds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

# Least scale of residuals, scale of a median, share of the scale beyond which a point counts less.
LEAST_SCALE, NORMAL, CUTOFF = 0.25, 1.4826, 1.5


def _residual(x: Column, y: Column) -> Column:
    """Distance of a point from a group's line."""
    return F.abs((x - F.col("_ax")) * F.col("_dy") - (y - F.col("_ay")) * F.col("_dx"))


def _along(dx: Column, dy: Column, px: Column, py: Column) -> Column:
    """-1 where a direction goes against another, else 1."""
    return F.when(dx * px + dy * py < 0, -1.0).otherwise(1.0)


def robust_lines(points: DataFrame, by: list[str], x: str, y: str, weight: str, directions: DataFrame, iterations: int = 3) -> DataFrame:
    """Rows (by, ax, ay, dx, dy, scale): line of each group of points by iteratively reweighted total least squares.

    In each round a point has its own weight, less where it lies farther from the last line than 1.5 scales; the line goes through the weighted
    mean, along the larger axis of the weighted covariance, on the side of the group's direction in ``directions`` (by, dx, dy);
    the scale is 1.4826 medians of the residuals, 0.25 at least. Moments are sums, added up before the shuffle, around the last mean; a
    round reads the points twice and keeps only a written row for each group, so neither lineage nor lists of points grow. The exact
    median holds the different residuals of one group in a task. Points with a null, or with a weight that isn't positive, raise;
    groups of one point, or without a direction, have no row.
    """
    spark = points.sparkSession
    folder = scratch.shared_folder(spark, "lines")
    bad = F.col(x).isNull() | F.col(y).isNull() | F.isnan(x) | F.isnan(y) | ~F.coalesce((F.col(weight) > 0) & (F.col(weight) < float("inf")), F.lit(False))
    known = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.when(bad, F.raise_error(F.lit("points and weights must be finite, weights positive")).cast("double")).otherwise(F.col(weight).cast("double")).alias("_w"))
    px, py = F.col("_x"), F.col("_y")
    start = known.groupBy(*by).agg(F.avg("_x").alias("_ax"), F.avg("_y").alias("_ay"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    lines = start.join(directions.select(*by, F.col("dx").cast("double").alias("_px"), F.col("dy").cast("double").alias("_py")), by)
    lines = lines.select(*by, "_ax", "_ay", F.lit(0.0).alias("_dx"), F.lit(0.0).alias("_dy"), "_px", "_py", F.lit(None).cast("double").alias("_scale"))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    lines = written(lines, "start")
    for k in range(iterations):
        residual, limit = _residual(px, py), CUTOFF * F.col("_scale")
        less = F.when(residual > limit, limit / residual).otherwise(1.0)  # without a scale there is no limit
        w, sx, sy = F.col("_w") * F.coalesce(less, F.lit(1.0)), px - F.col("_ax"), py - F.col("_ay")
        near = known.join(lines, by).select(*by, w.alias("w"), sx.alias("x"), sy.alias("y"), "_ax", "_ay", "_px", "_py")
        sums = near.groupBy(*by, "_ax", "_ay", "_px", "_py").agg(*[F.sum(e).alias(n) for n, e in {"s": F.col("w"), "mx": F.col("w") * F.col("x"), "my": F.col("w") * F.col("y"), "xx": F.col("w") * F.col("x") * F.col("x"), "xy": F.col("w") * F.col("x") * F.col("y"), "yy": F.col("w") * F.col("y") * F.col("y")}.items()])
        mx, my = F.col("mx") / F.col("s"), F.col("my") / F.col("s")
        cov = {"a": F.col("xx") / F.col("s") - mx * mx, "b": F.col("xy") / F.col("s") - mx * my, "c": F.col("yy") / F.col("s") - my * my}
        means = sums.select(*by, "_px", "_py", (F.col("_ax") + mx).alias("_ax"), (F.col("_ay") + my).alias("_ay"), *[e.alias(n) for n, e in cov.items()])
        turn = F.atan2(2.0 * F.col("b"), F.col("a") - F.col("c")) / 2.0
        axes = means.withColumn("_cx", F.cos(turn)).withColumn("_cy", F.sin(turn))
        side = _along(F.col("_cx"), F.col("_cy"), F.col("_px"), F.col("_py"))
        turned = written(axes.select(*by, "_ax", "_ay", (F.col("_cx") * side).alias("_dx"), (F.col("_cy") * side).alias("_dy"), "_px", "_py"), f"axes-{k}")
        medians = known.join(turned, by).groupBy(*by).agg(F.median(_residual(px, py)).alias("_median"))
        lines = written(turned.join(medians, by).withColumn("_scale", F.greatest(F.lit(LEAST_SCALE), NORMAL * F.col("_median"))).drop("_median"), f"lines-{k}")
    return lines.select(*by, F.col("_ax").alias("ax"), F.col("_ay").alias("ay"), F.col("_dx").alias("dx"), F.col("_dy").alias("dy"), F.col("_scale").alias("scale"))
