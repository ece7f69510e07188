"""Ordered operators over timelines: transitions, runs, debouncing, episodes, counters and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import line


def changes(df: DataFrame, keys: list[str], order: list[str], label: str, bridge: bool = True) -> DataFrame:
    """Rows whose label differs from the one before; bridge: nulls are left out first, else a pair with a null is none."""
    known = df.where(F.col(label).isNotNull()) if bridge else df
    w = line(keys, order)
    return known.withColumn("from_label", F.lag(label).over(w)).where(F.col("from_label").isNotNull() & F.col(label).isNotNull() & (F.col("from_label") != F.col(label))).withColumn("to_label", F.col(label))


def transition_counts(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Changes between consecutive known labels per key; 0 with one label, no row without any."""
    w = line(keys, order)
    known = df.where(F.col(label).isNotNull()).withColumn("_before", F.lag(label).over(w))
    return known.groupBy(*keys).agg(F.count_if(F.col("_before") != F.col(label)).alias("transitions"))


def skipped_pairs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Adjacent pairs and how many of them touch an unknown label."""
    w = line(keys, order)
    paired = df.withColumn("_row", F.lit(1)).withColumn("_has", F.lag("_row").over(w)).withColumn("_before", F.lag(label).over(w)).where("_has = 1")
    unknown = F.col(label).isNull() | F.col("_before").isNull()
    return paired.groupBy(*keys).agg(F.count_if(unknown).alias("skipped_pairs"), F.count_if(~unknown & (F.col("_before") != F.col(label))).alias("transitions"))


def runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """Adds run: the number of the maximal run of equal labels (null is a label of its own)."""
    w = line(keys, order)
    starts = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"))
    return df.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], label: str, start: str, end: str) -> DataFrame:
    """One row per run: label, first start, last end, rows."""
    return runs(df, keys, order, label).groupBy(*keys, "run", label).agg(F.min(start).alias("run_start"), F.max(end).alias("run_end"), F.count(F.lit(1)).alias("run_rows"))


def longest_runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    return runs(df, keys, order, label).where(F.col(label).isNotNull()).groupBy(*keys, label, "run").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys, label).agg(F.max("_n").alias("longest"))


def debounced(df: DataFrame, keys: list[str], order: list[str], label: str, k: int) -> DataFrame:
    """Transitions that k equal labels in a row confirm, stamped at the first of them; unknown rows are passed over.

    Over the known rows, a run of at least k rows confirms its label; a confirmed label that differs
    from the one confirmed before is a transition.  The first known label counts as confirmed.
    """
    known = df.where(F.col(label).isNotNull())
    w = line(keys, order)
    numbered = runs(known.withColumn("_n", F.row_number().over(w)), keys, order, label)
    confirmed = (
        numbered.groupBy(*keys, "run", F.col(label).alias("to_label"))
        .agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"), *(F.min_by(c, "_n").alias(c) for c in order if c != label))
        .where((F.col("_rows") >= k) | (F.col("_first") == 1))
    )
    v = Window.partitionBy(*keys).orderBy("_first")
    return confirmed.withColumn("from_label", F.lag("to_label").over(v)).where((F.col("from_label") != F.col("to_label")) & (F.col("_rows") >= k)).drop("_rows", "_first", "run")


def episodes(df: DataFrame, keys: list[str], order: list[str], label: str, abnormal: list[str], start: str, end: str) -> DataFrame:
    """Contiguous rows of one abnormal label, numbered in order per key."""
    found = run_lengths(df, keys, order, label, start, end).where(F.col(label).isin(abnormal))
    return found.withColumn("episode", F.row_number().over(Window.partitionBy(*keys).orderBy("run")) - 1).drop("run")


def confirmed_episodes(df: DataFrame, keys: list[str], order: list[str], label: str, wanted: str, k: int, duration: str) -> DataFrame:
    """Runs of at least k rows of a label: how many and their total duration."""
    grouped = runs(df, keys, order, label).where(F.col(label) == wanted).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_n"), F.sum(duration).alias("_d"))
    return grouped.groupBy(*keys).agg(F.count_if(F.col("_n") >= k).alias("confirmed"), F.coalesce(F.sum(F.when(F.col("_n") >= k, F.col("_d"))), F.lit(0)).alias("confirmed_duration"))


def episode_timer(df: DataFrame, keys: list[str], order: list[str], label: str, duration: str, wanted: str = "AF", resets: tuple[str, ...] = ("N", "Other")) -> DataFrame:
    """Adds timer: duration of the wanted label since the last reset; null before its first row; unknown holds."""
    w = line(keys, order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    spell = df.withColumn("_spell", F.sum(F.when(F.col(label).isin(*resets), 1).otherwise(0)).over(sofar))
    v = Window.partitionBy(*keys, "_spell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return spell.withColumn("timer", F.sum(F.when(F.col(label) == wanted, F.col(duration))).over(v)).drop("_spell")


def exceed_ratio(df: DataFrame, keys: list[str], order: list[str], value: str, above: float, rows: int) -> DataFrame:
    """Adds ratio and samples over the last rows: missing values stay in the denominator, all missing is null."""
    frame = line(keys, order).rowsBetween(1 - rows, 0)
    share = F.sum(F.when(F.col(value) > above, 1.0).otherwise(0.0)).over(frame) / F.count(F.lit(1)).over(frame)
    return df.withColumn("samples", F.count(F.lit(1)).over(frame)).withColumn("ratio", F.when(F.count(value).over(frame) > 0, share))


def trailing_stats(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """Mean, minimum and maximum of the last known values, carried over rows where it is missing."""
    w = line(keys, order)
    known = df.where(F.col(value).isNotNull())
    frame = w.rowsBetween(1 - rows, 0)
    stats = known.select(*keys, *order, F.avg(value).over(frame).alias("mean"), F.min(value).over(frame).alias("min"), F.max(value).over(frame).alias("max"))
    joined = df.join(stats, [*keys, *order], "left")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({f"trailing_{c}": F.last(c, ignorenulls=True).over(sofar) for c in ("mean", "min", "max")}).drop("mean", "min", "max")


def alert_edges(df: DataFrame, keys: list[str], order: list[str], active: Column, signature: Column) -> DataFrame:
    """Rows that alert: newly active, or active with another signature than the row before."""
    w = line(keys, order)
    marked = df.withColumn("_active", active).withColumn("_signature", signature)
    before, was = F.lag("_signature").over(w), F.coalesce(F.lag("_active").over(w), F.lit(False))
    return marked.withColumn("emit", F.col("_active") & (~was | ~F.col("_signature").eqNullSafe(before))).where("emit").drop("emit", "_active", "_signature")


def reuse_groups(df: DataFrame, keys: list[str], order: list[str], signature: str, reuses: int) -> DataFrame:
    """Adds fresh: true where a cached answer for an unchanged signature may not be reused any more."""
    with_runs = runs(df, keys, order, signature)
    v = Window.partitionBy(*keys, "run").orderBy(*order)
    return with_runs.withColumn("fresh", (F.row_number().over(v) - 1) % (reuses + 1) == 0).drop("run")


def snapshots(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """The last row of every block of `every` rows, the short last block included."""
    w = line(keys, order)
    blocked = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("snapshot", F.floor(F.col("_n") / every))
    v = Window.partitionBy(*keys, "snapshot").orderBy(F.desc("_n"))
    return blocked.withColumn("_r", F.row_number().over(v)).where("_r = 1").drop("_r", "_n")


def keep_last(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    v = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(v)).where(F.col("_r") <= rows).drop("_r")


def rhythm_segments(beats: DataFrame, keys: list[str], order: list[str], at: str, label: str) -> DataFrame:
    """Run-length encoding of beat labels: a segment ends at the beat after its last one, or at its last beat."""
    w = line(keys, order)
    ahead = runs(beats.withColumn("_next", F.coalesce(F.lead(at).over(w), F.col(at))), keys, order, label)
    return ahead.groupBy(*keys, "run", label).agg(F.min(at).alias("seg_start"), F.max("_next").alias("seg_end"))


def change_markers(beats: DataFrame, keys: list[str], order: list[str], at: str, label: str, total: Column) -> DataFrame:
    """Spans of constant label: the first begins at 0, each ends where the next begins, the last at the total."""
    w = line(keys, order)
    first = F.row_number().over(w) == 1
    marks = beats.withColumn("_mark", first | ~F.col(label).eqNullSafe(F.lag(label).over(w))).withColumn("_total", total).withColumn("span_start", F.when(first, F.lit(0)).otherwise(F.col(at))).where("_mark")
    return marks.withColumn("span_end", F.least(F.lead("span_start").over(w), F.col("_total"))).withColumn("span_end", F.coalesce("span_end", "_total")).drop("_mark", "_total")


def _half_away(x: Column, digits: int) -> Column:
    """Rounds as SQL engines do on doubles: scaled, halves away from zero; F.round takes the shortest decimal instead."""
    y = F.abs(x * 10.0**digits)
    whole = F.floor(y).cast("double")
    return F.when(y < 2.0**52, F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits).otherwise(x)


def ema_skip(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.05, band: float = 0.2, digits: int = 1) -> DataFrame:
    """Personal baseline per row: an exponential mean that ignores values off by `band` or more, rounded at each step.

    The recurrence is not linear, so a key's values fold in order inside the JVM; a key is one array of
    doubles, eight bytes a row.
    """
    held = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_rows"))
    step = lambda acc, x: F.when(acc.isNull(), _half_away(x["_v"], digits)).when(F.abs(x["_v"] - acc) >= band * acc, acc).otherwise(_half_away(acc + alpha * (x["_v"] - acc), digits))
    folded = F.aggregate("_rows", F.lit(None).cast("double"), step)
    return held.select(*keys, folded.alias("baseline"), F.size("_rows").cast("long").alias("values"))
