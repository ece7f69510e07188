"""Interval joins and what is computed from overlaps.

Axes are integers (microseconds or samples), intervals half open.  A range join deals both sides into
bins and joins them on (keys, bin): a pair that shares several bins is kept in the bin where its
overlap begins, so that no distinct is needed.  Long intervals cost one row per bin they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    solid = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    return solid.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: int) -> DataFrame:
    """All pairs of equal keys whose intervals overlap, with overlap_start and overlap_end."""
    (ls, le), (rs, re) = left_bounds, right_bounds
    both = _binned(left, ls, le, width).join(_binned(right, rs, re, width), [*keys, "_bin"])
    low, high = F.greatest(ls, rs), F.least(le, re)
    return both.where((low < high) & (F.floor(low / width) == F.col("_bin"))).drop("_bin").withColumns({"overlap_start": low, "overlap_end": high})


def contained_points(points: DataFrame, windows: DataFrame, keys: list[str], at: str, bounds: tuple[str, str], width: int) -> DataFrame:
    """Points inside windows [start, end)."""
    start, end = bounds
    binned = points.withColumn("_bin", F.floor(F.col(at) / width))
    return binned.join(_binned(windows, start, end, width), [*keys, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def best_label(overlaps: DataFrame, keys: list[str], label: str, priority: dict[str, int], min_overlap: int = 0) -> DataFrame:
    """The label with the longest total overlap; equal totals go to the higher priority."""
    size = F.col("overlap_end") - F.col("overlap_start")
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col(label)], F.lit(-1))
    totals = overlaps.where(F.col(label).isNotNull() & (size >= min_overlap)).groupBy(*keys, label).agg(F.sum(size).alias("total"))
    return totals.groupBy(*keys).agg(F.max_by(label, F.struct("total", rank)).alias("dominant"), F.max("total").alias("dominant_total"))


def burden(overlaps: DataFrame, keys: list[str], label: str, wanted: str, window_size: Column) -> DataFrame:
    """Share of the wanted label in what is annotated and in the whole window, and whether all of it is annotated."""
    size = F.col("overlap_end") - F.col("overlap_start")
    known = F.sum(F.when(F.col(label).isNotNull(), size))
    hit = F.coalesce(F.sum(F.when(F.col(label) == wanted, size)), F.lit(0))
    return overlaps.groupBy(*keys).agg(
        F.when(known > 0, F.try_divide(hit, known)).alias("annotated_burden"),
        F.try_divide(hit, F.first(window_size)).alias("window_burden"),
        F.try_divide(F.coalesce(known, F.lit(0)), F.first(window_size)).alias("coverage"),
        (F.coalesce(known, F.lit(0)) >= F.first(window_size)).alias("fully_covered"),
    )


def window_label(burden_column: Column, covered: Column, eps: float = 1e-9) -> Column:
    """NSR up to 0.05, AF from 0.80, transition between; unlabeled unless fully covered."""
    return F.when(~covered | burden_column.isNull(), "unlabeled").when(burden_column <= 0.05 + eps, "NSR").when(burden_column >= 0.80 - eps, "AF").otherwise("transition")


def burden_rhythm(burden_column: Column, threshold: float = 0.5, margin: float = 0.0) -> Column:
    """AF at or above the threshold, null within the margin around it."""
    return F.when(burden_column.isNull(), None).when((F.abs(burden_column - threshold) < margin), None).when(burden_column >= threshold, "AF").otherwise("N")


def mode_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value and its share; equal counts go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias("mode"), F.max("_n").alias("mode_count"), F.sum("_n").alias("total")).withColumn("fraction", F.col("mode_count") / F.col("total"))


def alignment(pairs: DataFrame, keys: list[str], inner: tuple[str, str], outer: tuple[str, str]) -> DataFrame:
    """Whether any and whether all of the inner intervals meet or lie inside their outer one."""
    (s, e), (os, oe) = inner, outer
    meets = (F.col(s) < F.col(oe)) & (F.col(e) > F.col(os))
    inside = (F.col(s) >= F.col(os)) & (F.col(e) <= F.col(oe))
    return pairs.groupBy(*keys).agg(F.bool_or(meets).alias("any_overlap"), F.bool_and(inside).alias("all_inside"), F.count_if(meets).alias("n_overlap"))


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Total length covered by at least one interval."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return df.withColumn("_gain", gain).groupBy(*keys).agg(F.sum("_gain").alias("covered"))
