"""Fixed-size windows over recordings: tumbling, sliding, sub-windows and gap-free runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(points: DataFrame, keys: list[str], at: str, width: int, aggregates: list[Column], extent: int | None = None) -> DataFrame:
    """Aggregates per window of `width`; with an extent, a window that does not fit before it is dropped."""
    grouped = points.groupBy(*keys, F.floor(F.col(at) / width).alias("window")).agg(*aggregates)
    return grouped if extent is None else grouped.where((F.col("window") + 1) * width <= extent)


def sliding(points: DataFrame, keys: list[str], at: str, width: int, stride: int, aggregates: list[Column], extent: int | None = None) -> DataFrame:
    """Aggregates per window start: every multiple of the stride whose window holds points (and fits before the extent).

    Each point enters width / stride windows; partial aggregation runs before the shuffle.
    """
    last = F.floor(F.col(at) / stride)
    first = F.greatest(F.lit(0), F.floor((F.col(at) - width) / stride) + 1)
    grouped = points.withColumn("window", F.explode(F.sequence(first, last))).groupBy(*keys, "window").agg(*aggregates)
    grouped = grouped.withColumn("window_start", F.col("window") * F.lit(stride)).drop("window")
    return grouped if extent is None else grouped.where(F.col("window_start") + width <= extent)


def grid(bounds: DataFrame, start: str, end: str, width: int, stride: int) -> DataFrame:
    """One row per window [window_start, window_start + width) that fits into [start, end)."""
    fits = F.col(end) - F.col(start) >= width
    starts = F.when(fits, F.sequence(F.col(start), F.col(end) - F.lit(width), F.lit(stride).cast("long")))
    return bounds.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + F.lit(width))


def rate_per_minute(count: Column, duration_us: Column) -> Column:
    """Beats per minute; no beats is null, not 0."""
    return F.try_divide(F.nullif(count, F.lit(0)), duration_us / F.lit(60_000_000.0))


def peak_rate(beats: DataFrame, keys: list[str], at: str, window: int, sub: int, extent: int) -> DataFrame:
    """Highest rate over sub-windows of each window; empty ones are left out, the last partial one keeps its own duration."""
    placed = beats.where(F.col(at) < extent).withColumn("window", F.floor(F.col(at) / window)).withColumn("sub", F.floor((F.col(at) - F.col("window") * window) / sub))
    counted = placed.groupBy(*keys, "window", "sub").agg(F.count(F.lit(1)).alias("n"))
    begin = F.col("window") * window + F.col("sub") * sub
    duration = F.least(begin + sub, (F.col("window") + 1) * window, F.lit(extent)) - begin
    return counted.withColumn("rate", rate_per_minute(F.col("n"), duration)).groupBy(*keys, "window").agg(F.max("rate").alias("peak"), F.min(F.when(duration == sub, F.col("rate"))).alias("least_complete"))


def sessions(df: DataFrame, keys: list[str], order: list[str], at: str, gap: int) -> DataFrame:
    """Adds session: rows at most `gap` after the one before share it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def complete_groups(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Mean of each complete group of `size` consecutive rows over its known values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    grouped = df.withColumn("group", F.floor((F.row_number().over(w) - 1) / size)).groupBy(*keys, "group").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("_n"))
    return grouped.where(F.col("_n") == size).drop("_n")


def cumulative_offsets(segments: DataFrame, keys: list[str], order: list[str], start: str, duration: str) -> DataFrame:
    """Adds offset: time since the first segment by start times, never going back; without a start the duration before counts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.greatest(F.lit(0), F.coalesce(F.col(start) - F.lag(start).over(w), F.lag(duration).over(w), F.lit(0)))
    return segments.withColumn("_step", step).withColumn("offset", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def inferred_durations(df: DataFrame, keys: list[str], order: list[str], offset: str, duration: str) -> DataFrame:
    """Adds filled: the durations if all are positive, else offset steps with the last positive one for gaps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    every = Window.partitionBy(*keys)
    explicit = F.min(F.when(F.col(duration) > 0, 1).otherwise(0)).over(every) == 1
    step = F.lead(offset).over(w) - F.col(offset)
    marked = df.withColumn("_step", F.when(step > 0, step)).withColumn("_last", F.last("_step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return marked.withColumn("filled", F.when(explicit, F.col(duration)).otherwise(F.coalesce("_step", "_last", F.lit(0)))).drop("_step", "_last")
