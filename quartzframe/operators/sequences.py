"""Peaks, runs and separations in ordered values: as arrays of one row, and as rows with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_maxima(values: Column) -> Column:
    """Places (from 0) of inner values not below the one before and above the one after."""
    at = F.transform(values, lambda v, i: F.when((i > 0) & (i < F.size(values) - 1) & (v >= F.get(values, i - 1)) & (v > F.get(values, i + 1)), i))
    return F.array_compact(at)


def longest_false_share(flags: Column) -> Column:
    """Length of the longest run of false as a share of all; 1 for no flags."""
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("most"))
    step = lambda s, f: F.when(f, F.struct(F.lit(0).alias("run"), s["most"].alias("most"))).otherwise(F.struct((s["run"] + 1).alias("run"), F.greatest(s["most"], s["run"] + 1).alias("most")))
    return F.when(F.size(flags) > 0, F.aggregate(flags, state, step, lambda s: s["most"] / F.size(flags))).otherwise(1.0)


def separated(items: Column, place: str, least: float, most: int) -> Column:
    """Greedy pick from items in order of preference: each at least ``least`` away from all picked before, ``most`` at most."""
    empty = F.slice(items, 1, 0)
    return F.aggregate(items, empty, lambda picked, x: F.when((F.size(picked) < most) & F.forall(picked, lambda p: F.abs(p[place] - x[place]) >= least), F.concat(picked, F.array(x))).otherwise(picked))


def runs(rows: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Rows (by, flag, run, length) of runs of equal flags, in order."""
    w, v = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, flag).orderBy(*order)
    marked = rows.select(*by, *order, flag, (F.row_number().over(w) - F.row_number().over(v)).alias("run"))
    return marked.groupBy(*by, flag, "run").agg(F.count(F.lit(1)).alias("length"))


def longest_false_by_group(rows: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Rows (by, rows, longest, share): the longest run of false in each group's order."""
    return runs(rows, by, order, flag).groupBy(*by).agg(F.sum("length").alias("rows"), F.coalesce(F.max(F.when(~F.col(flag), F.col("length"))), F.lit(0)).alias("longest")).withColumn("share", F.col("longest") / F.col("rows"))


def peaks(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is not below the one before and above the one after, both there."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.select("*", F.lag(value).over(w).alias("_before"), F.lead(value).over(w).alias("_after"))
    return marked.where((F.col(value) >= F.col("_before")) & (F.col(value) > F.col("_after"))).drop("_before", "_after")


def merged_intervals(rows: DataFrame, by: list[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Overlapping or nearly adjacent intervals of a group as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_run")
