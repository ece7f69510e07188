"""Longer views of a monitored timeline: beat intervals, medium-term variability, episode log, trends and reports.

Everything is windows and aggregates per timeline; running sums stand in for long sliding frames, so that
a row costs the same whatever the length of the buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as seq
from .rules import rank, urgency_of
from .state import line

CENTRE = 800.0  #: taken off intervals before they are squared, so that running sums stay exact


def beat_intervals(beats: DataFrame, keys: list[str], order: list[str], at: str, interval: str, label: str) -> DataFrame:
    """(keys, start, end, label) from beat to beat; where a timeline has one beat only, from the summed intervals.

    Intervals that do not go forward are left out; the last beat opens none.
    """
    w = line(keys, order)
    sofar = w.rowsBetween(Window.unboundedPreceding, -1)
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    before = F.coalesce(F.sum(F.when(F.col(interval) > 0, F.col(interval))).over(sofar), F.lit(0))
    start = F.when(several, F.col(at)).otherwise(before)
    end = F.when(several, F.lead(at).over(w)).otherwise(before + F.col(interval))
    return beats.select(*keys, start.alias("start"), end.alias("end"), F.col(label).alias("label")).where("end > start")


def medium_hrv(rows: DataFrame, keys: list[str], order: list[str], intervals: str, size: int = 10_800, low: float = 300, high: float = 2000) -> DataFrame:
    """Per window the spread of the last `size` intervals: sdnn and rmssd over those of them that are plausible.

    The buffer is cut before implausible intervals are left out, and differences are between survivors that
    follow each other, also across windows.  Null with fewer than three survivors; a window without
    intervals has the values of the one before.
    """
    each = rows.select(*keys, *order, F.posexplode(intervals).alias("_place", "_x"))
    w = line(keys, [*order, "_place"])
    sofar, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    good = each.withColumn("_y", F.when(F.col("_x").between(low, high), F.col("_x") - CENTRE))
    last = F.last("_y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    squared = good.withColumn("_d", F.when(F.col("_y").isNotNull(), F.coalesce((F.col("_y") - last) * (F.col("_y") - last), F.lit(0.0))))
    summed = squared.withColumns({
        "_n": F.count("_y").over(sofar), "_s": F.coalesce(F.sum("_y").over(sofar), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("_y") * F.col("_y")).over(sofar), F.lit(0.0)),
        "_r": F.coalesce(F.sum("_d").over(sofar), F.lit(0.0)), "_f": F.first("_d", ignorenulls=True).over(ahead),
    })
    cut = summed.withColumns({c: F.col(c) - F.coalesce(F.lag(c, size).over(w), F.lit(0)) for c in ("_n", "_s", "_q", "_r")}).withColumn("_f", F.coalesce(F.lag("_f", size - 1).over(w), F.lit(0.0)))
    enough = F.col("_n") >= 3
    sdnn = F.when(enough, F.sqrt(F.greatest(F.lit(0.0), (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))))
    rmssd = F.when(enough, F.sqrt(F.greatest(F.lit(0.0), (F.col("_r") - F.col("_f")) / (F.col("_n") - 1))))
    final = F.row_number().over(Window.partitionBy(*keys, *order).orderBy(F.desc("_place"))) == 1
    values = cut.select(*keys, *order, F.struct(sdnn.alias("sdnn"), rmssd.alias("rmssd"), F.col("_n").alias("intervals")).alias("_v"), final.alias("_final")).where("_final").drop("_final")
    carried = rows.join(values, [*keys, *order], "left").withColumn("_v", F.last("_v", ignorenulls=True).over(line(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    return carried.withColumns({c: F.col(f"_v.{c}") for c in ("sdnn", "rmssd", "intervals")}).drop("_v")


def episode_log(judged: DataFrame, keys: list[str], order: list[str], index: str, at: str, vitals: str) -> DataFrame:
    """Episodes of consecutive rows with triggered rules (columns triggered, urgency).

    An episode opens with its first rule and urgency, collects further rules in the order of appearance, has
    its peak at the first row of its highest urgency, and is closed by the next row without rules, whose
    index and time are its end; the last one may still be active.
    """
    active = judged.withColumn("_active", F.size("triggered") > 0)
    marked = seq.runs(active, keys, order, "_active")
    first = F.struct(*order)
    rules = marked.where("_active").select(*keys, "run", *order, F.posexplode("triggered").alias("_k", "_rule"))
    found = rules.groupBy(*keys, "run", "_rule").agg(F.min(F.struct(*order, "_k")).alias("_at"))
    listed = found.groupBy(*keys, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_rule"))), lambda r: r["_rule"]).alias("rules"))
    place = rank(F.col("urgency"))
    # the first of the rows with the highest urgency: the smallest of (lowest place last, order)
    runs = marked.groupBy(*keys, "run", "_active").agg(
        F.min(index).alias("start_index"), F.min_by(at, first).alias("start_at"), F.min_by("urgency", first).alias("urgency_initial"), F.max(place).alias("_top"),
        F.min_by(F.get("triggered", F.lit(0)), first).alias("episode_type"), F.min_by(vitals, first).alias("vitals_at_start"), F.min_by(vitals, F.struct(-place, *order)).alias("vitals_at_peak"),
    )
    w = Window.partitionBy(*keys).orderBy("run")
    closed = runs.withColumns({"end_index": F.lead("start_index").over(w), "end_at": F.lead("start_at").over(w)}).where("_active")
    numbered = closed.withColumn("episode", F.row_number().over(w) - 1).withColumn("urgency_max", urgency_of(F.col("_top")))
    status = F.when(F.col("end_index").isNull(), "active").otherwise("resolved")
    return numbered.withColumns({"was_escalated": F.col("_top") > rank(F.col("urgency_initial")), "status": status}).join(listed, [*keys, "run"]).drop("run", "_active", "_top")


def recent_episodes(judged: DataFrame, keys: list[str], order: list[str], last: int) -> DataFrame:
    """Adds recent: how many episodes began within the last rows before a row, and with it."""
    w = line(keys, order)
    active = F.size("triggered") > 0
    began = (active & ~F.coalesce(F.lag(active).over(w), F.lit(False))).cast("int")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = judged.withColumn("_began", began).withColumn("_sum", F.sum("_began").over(sofar))
    return counted.withColumn("recent", F.col("_sum") - F.coalesce(F.lag("_sum", last + 1).over(w), F.lit(0))).drop("_began", "_sum")


def last_episode(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last episode of each type."""
    return log.groupBy(*keys, "episode_type").agg(F.max("episode").alias("episode"), F.max_by("status", "episode").alias("status"), F.max_by("start_at", "episode").alias("start_at"))


def alerts_by_rule(alerts: DataFrame, keys: list[str], rules: str) -> DataFrame:
    """Alerts of each rule; one without any counts as `(none)`."""
    named = F.when(F.size(rules) > 0, F.col(rules)).otherwise(F.array(F.lit("(none)")))
    return alerts.select(*keys, F.explode(named).alias("rule_id")).groupBy(*keys, "rule_id").agg(F.count(F.lit(1)).alias("alerts"))


def trend_snapshots(rows: DataFrame, keys: list[str], order: list[str], every: int, at: str, hr: str, anomaly: Column) -> DataFrame:
    """One row for each block of `every` windows, the short last one included."""
    numbered = rows.withColumn("_n", F.row_number().over(line(keys, order)) - 1)
    return numbered.groupBy(*keys, F.floor(F.col("_n") / every).alias("snapshot")).agg(
        F.min("_n").alias("first_window"), F.max("_n").alias("last_window"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.avg(hr).alias("mean_hr"), F.count_if(anomaly).alias("anomalies")
    )


def trend_summary(snapshots: DataFrame, keys: list[str], recent: int = 4, before: int = 4) -> DataFrame:
    """Range of the snapshots' means, all anomalies, and the last snapshots against those before (null with too few)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("snapshot"))
    ranked = snapshots.withColumn("_r", F.row_number().over(w))
    now, then = F.col("_r") <= recent, F.col("_r").between(recent + 1, recent + before)
    whole = F.count(F.lit(1)) >= recent + before
    side = lambda when, f, c: F.when(whole, f(F.when(when, F.col(c))))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("snapshots"), F.min("mean_hr").alias("hr_low"), F.max("mean_hr").alias("hr_high"), F.sum("anomalies").alias("total_anomalies"),
        side(now, F.avg, "mean_hr").alias("recent_hr"), side(then, F.avg, "mean_hr").alias("previous_hr"), (side(now, F.sum, "anomalies") - side(then, F.sum, "anomalies")).alias("anomaly_delta"),
    )


def intervention_report(windows: Column, episodes: DataFrame, placed: DataFrame, keys: list[str], start: str, at: str) -> DataFrame:
    """One row: totals of alerts placed by match_alerts, precision and recall of first hits, and their latencies."""
    hits = placed.where("outcome = 'hit'").join(episodes, [*keys, "episode"]).select((F.col(at) - F.col(start)).alias("latency"))
    counts = placed.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("outcome") == "hit").alias("matched"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count_if(F.col("outcome") == "false").alias("false_alerts"))
    total = episodes.agg(F.count(F.lit(1)).alias("episodes"))
    v = F.col("latency")
    late = hits.agg(F.avg(v).alias("latency_mean"), F.percentile(v, F.lit(0.5)).alias("latency_median"), F.percentile(v, F.lit(0.9)).alias("latency_p90"), F.max(v).alias("latency_max"))
    row = counts.crossJoin(total).crossJoin(late)  # one row each
    p, r = F.coalesce(F.try_divide("matched", "events"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "episodes"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return row.withColumns({"windows": windows, "missed": F.greatest(F.lit(0), F.col("episodes") - F.col("matched")), "precision": p, "recall": r, "f1": f1})


def baseline_snapshot(last: DataFrame, least: int = 30) -> DataFrame:
    """Adds numeric_ready: resting rate, sdnn and rmssd are known and enough windows have been seen."""
    known = F.col("baseline").isNotNull() & F.col("sdnn").isNotNull() & F.col("rmssd").isNotNull()
    return last.withColumn("numeric_ready", known & (F.col("windows") >= least))


def replay_summary(rows: DataFrame, keys: list[str], at: str, active: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.count_if(active).alias("active_windows"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def transition_rate(rows: DataFrame, keys: list[str], order: list[str], label: str, seconds: Column) -> DataFrame:
    """Changes an hour over the span of all rows: null without any label, and 0 for it in the other form."""
    changes = seq.transition_counts(rows, keys, order, label)
    spans = rows.groupBy(*keys).agg(seconds.alias("_seconds"))
    rate = F.try_divide(F.col("transitions") * 3600.0, F.col("_seconds"))
    return spans.join(changes, keys, "left").select(*keys, rate.alias("per_hour"), F.coalesce(rate, F.lit(0.0)).alias("per_hour_or_zero"))


def annotation_bounds(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"))


def half_minute_rates(intervals: DataFrame, keys: list[str], order: list[str], interval: str, seconds: str, width: float = 30.0) -> DataFrame:
    """Beats a minute of every whole half minute with two beats or more, from intervals in milliseconds.

    The first beat is at 0, each further one where its interval ends; later than the recording none counts.
    Intervals add up exactly, to the picosecond: a beat at the turn of a half minute belongs to the next one.
    """
    w = line(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    exact = f"try_cast(`{interval}` AS DECIMAL(28, 9))"
    good = intervals.where(F.col(interval) > 0).withColumn("_known", F.expr(exact).isNotNull()).withColumn("_ms", F.expr(exact))
    # a beat after an interval without end is after any recording
    later = good.select(*keys, F.sum("_ms").over(w).alias("at"), F.min("_known").over(w).alias("_known"), F.col(seconds).alias("_end")).where("_known").drop("_known")
    first = good.groupBy(*keys).agg(F.first(seconds).alias("_end")).select(*keys, F.lit(0).cast(later.schema["at"].dataType).alias("at"), "_end")
    end = F.expr("try_cast(_end * 1000 AS DECIMAL(38, 9))")
    beats = later.unionByName(first).where(F.when(end.isNotNull(), F.col("at") < end).otherwise(F.col("_end") > 0))
    counted = beats.withColumn("half_minute", F.expr(f"at div {width * 1000:.9f}BD")).groupBy(*keys, "half_minute", "_end").agg(F.count(F.lit(1)).alias("_n"))
    whole = (F.col("half_minute") + 1) * width <= F.col("_end") + 1e-9
    return counted.where(whole & (F.col("_n") >= 2)).select(*keys, "half_minute", (F.col("_n") / width * 60.0).alias("bpm"))


def inferred_rate(size: Column, known: list[Column], fallback: float) -> Column:
    """Samples a second of a channel from the median duration of the channels whose rate is known."""
    durations = F.filter(F.array(*known), lambda d: d.isNotNull() & (d > 0))
    ordered, n = F.array_sort(durations), F.size(durations)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    rate = F.try_divide(size, middle)
    return F.when((n > 0) & (rate > 0), rate).otherwise(F.lit(fallback))


def shortest(durations: list[Column]) -> Column:
    """The duration that all channels cover; unknown ones do not count."""
    return F.least(*durations)


def first_change_start(markers: DataFrame, keys: list[str], at: str, max_windows: int, stride: int) -> DataFrame:
    """Where a short replay begins, so that it still holds the second change marker: some strides before it, not below 0."""
    w = Window.partitionBy(*keys).orderBy(at)
    second = markers.withColumn("_n", F.row_number().over(w)).where("_n = 2")
    lead = min(max(max_windows // 4, 1), 50) * stride
    return second.select(*keys, F.greatest(F.lit(0), F.col(at) - lead).alias("start"))
