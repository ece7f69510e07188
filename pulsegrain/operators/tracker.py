"""The batch twin of the monitoring stream: every row of a timeline with the tracker's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as seq


def track(rows: DataFrame, keys: list[str], order: list[str], hr: str = "hr_bpm", rhythm: str = "rhythm_class", duration: str = "dur_us", short: int = 30) -> DataFrame:
    """Adds tachy_ratio, tachy_samples (over the last rows), af_episode (timer) and window_s.

    All frames share one partitioning and order, so that the timeline is sorted once.
    """
    with_ratio = seq.exceed_ratio(rows, keys, order, hr, 100, short).withColumnsRenamed({"ratio": "tachy_ratio", "samples": "tachy_samples"})
    timed = seq.episode_timer(with_ratio, keys, order, rhythm, duration).withColumnRenamed("timer", "af_episode")
    return timed.withColumns({"window_s": F.col(duration) / 1e6, "af_episode_s": F.col("af_episode") / 1e6})


def summarise(rows: DataFrame, keys: list[str], order: list[str], rhythm: str, duration: str, hr: str, k: int = 2) -> DataFrame:
    """Monitoring aggregate: time-weighted AF burden over all windows, highest rate, raw and debounced changes, confirmed AF."""
    base = rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(F.col(rhythm) == "AF", F.col(duration)).otherwise(0)), F.sum(duration)).alias("af_burden"), F.max(hr).alias("max_hr"), F.sum(duration).alias("monitored"), F.count(F.lit(1)).alias("windows")
    )
    raw = seq.transition_counts(rows, keys, order, rhythm)
    steady = seq.debounced(rows, keys, order, rhythm, k).groupBy(*keys).agg(F.count(F.lit(1)).alias("debounced"))
    confirmed = seq.confirmed_episodes(rows, keys, order, rhythm, "AF", k, duration)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return base.join(raw, keys, "left").join(steady, keys, "left").join(confirmed, keys, "left").withColumn("debounced", F.when(F.col("transitions").isNotNull(), zero("debounced"))).withColumns({c: zero(c) for c in ("confirmed", "confirmed_duration")})


def rhythm_summary(rows: DataFrame, keys: list[str], order: list[str], rhythm: str, sustained: int = 3) -> DataFrame:
    """Per key: known rows, share of each class, longest run of each, the dominant class (ties AF, N, Other) and sustained classes."""
    longest = seq.longest_runs(rows, keys, order, rhythm)
    counts = rows.where(F.col(rhythm).isNotNull()).groupBy(*keys, rhythm).agg(F.count(F.lit(1)).alias("n")).join(longest, [*keys, rhythm])
    place = F.when(F.col(rhythm) == "AF", 3).when(F.col(rhythm) == "N", 2).otherwise(1)
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("known"),
        F.max_by(rhythm, F.struct("n", place)).alias("dominant"),
        F.max("n").alias("dominant_n"),
        F.max(F.when(F.col(rhythm) == "AF", F.col("longest"))).alias("longest_af"),
        F.array_sort(F.collect_set(F.when(F.col("longest") >= sustained, F.col(rhythm)))).alias("sustained"),
    )


def period_comparison(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int, m: int) -> DataFrame:
    """Mean of the last n rows against the m before; null with fewer rows."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n + m)
    both = ranked.groupBy(*keys).agg(F.avg(F.when(F.col("_r") <= n, F.col(value))).alias("recent"), F.avg(F.when(F.col("_r") > n, F.col(value))).alias("before"), F.max("_r").alias("_rows"))
    return both.select(*keys, *(F.when(F.col("_rows") == n + m, F.col(c)).alias(c) for c in ("recent", "before")))
