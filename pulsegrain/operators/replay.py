"""Replays: sub-windows under the rules, previous windows from raw beats, record projections, live sessions as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrain.functions import vitals as vt

from . import intervals as iv
from . import rules as rl
from . import tracker as tr


def sub_windows(windows: DataFrame, keys: list[str], start: str, end: str, width: int = 10, least: int = 10, most: int = 600) -> DataFrame:
    """Whole sub-windows of each window: one of less than `least` has none, one of more than `most` is cut."""
    stop = F.least(F.col(end), F.col(start) + most)
    n = F.floor((stop - F.col(start)) / width)
    grid = windows.where((stop - F.col(start) >= least) & (n >= 1)).withColumn("sub_index", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return grid.withColumns({"sub_start": F.col(start) + F.col("sub_index") * width, "sub_end": F.col(start) + (F.col("sub_index") + 1) * width})


def replay_rules(subs: DataFrame, beats: DataFrame, keys: list[str], at: str, width: int, rules: list[rl.Rule]) -> DataFrame:
    """The sub-windows with their rate by beats and the rules over the tracker; sub-windows without beats leave it as it was."""
    counted = iv.contained_points(beats.select(*keys, at), subs, keys, at, ("sub_start", "sub_end"), width).groupBy(*keys, "sub_index").agg(F.count(F.lit(1)).alias("_n"))
    rated = subs.join(counted, [*keys, "sub_index"]).withColumns({"hr_bpm": F.col("_n") * 60.0 / width, "rhythm_class": F.lit(None).cast("string"), "_us": F.lit(width * 1_000_000)}).drop("_n")
    return rl.evaluate(tr.track(rated, keys, ["sub_index"], duration="_us"), rules)


def previous_from_raw(windows: DataFrame, beats: DataFrame, keys: list[str], index: str, bounds: tuple[str, str], at: str, width: int, first: str) -> DataFrame:
    """Adds previous_beats: the beats of the adjacent span of equal width before each window, whatever the grid.

    Null where that span begins before the recording (column `first`).
    """
    start, _ = bounds
    before = windows.select(*keys, index, (F.col(start) - width).alias("_from"), F.col(start).alias("_to"), F.col(first).alias("_first")).where("_from >= _first")
    counted = iv.contained_points(beats.select(*keys, at), before, keys, at, ("_from", "_to"), width).groupBy(*keys, index).agg(F.count(F.lit(1)).alias("_n"))
    known = before.select(*keys, index).join(counted, [*keys, index], "left").withColumn("previous_beats", F.coalesce("_n", F.lit(0))).drop("_n")
    return windows.join(known, [*keys, index], "left")


def truth_label(overlaps: DataFrame, keys: list[str], label: str, start: str, end: str, known: dict[str, str]) -> DataFrame:
    """The label with the longest overlap, of equal ones the one seen first; nulls are Unknown, unmapped ones Other."""
    mapped = F.when(F.col(label).isNull(), "Unknown").otherwise(F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.col(label)], F.lit("Other")))
    each = overlaps.groupBy(*keys, mapped.alias("_label")).agg(F.sum(F.col(end) - F.col(start)).alias("_d"), F.min(start).alias("_at"))
    return each.groupBy(*keys).agg(F.max_by("_label", F.struct(F.col("_d"), -F.col("_at"))).alias("truth"))


def analysed(rows: DataFrame, intervals: Column, process: Callable[[Column], Column] = vt.heart_rate, classify: Callable[[Column], Column] = vt.classify_rhythm) -> DataFrame:
    """Adds hr_bpm and rhythm_class by kernels that a caller may replace."""
    return rows.withColumns({"hr_bpm": process(intervals), "rhythm_class": F.nullif(classify(intervals), F.lit("Unknown"))})


def event_records(results: DataFrame, own: str, window: str) -> DataFrame:
    """Event records of results (a map each), with what their window says where they are silent, else defaults."""
    given = lambda k: F.coalesce(F.col(own)[k], F.col(window)[k])
    return results.select(
        *(c for c in results.columns if c not in (own, window)),
        given("patient_id").alias("patient_id"), given("segment_id").alias("segment_id"), given("window_index").try_cast("int").alias("window_index"), given("stream_offset_s").try_cast("double").alias("offset_s"),
        F.coalesce(F.col(own)["urgency"], F.lit("none")).alias("urgency"), F.filter(F.split(F.coalesce(F.col(own)["triggered_rules"], F.lit("")), ","), lambda r: r != "").alias("triggered_rules"),
        F.coalesce(F.col(own)["reason"], F.lit("")).alias("reason"), F.coalesce(F.col(own)["condition_active"].try_cast("boolean"), F.lit(False)).alias("condition_active"),
    )


def duration_of(*places: Column) -> Column:
    """The first of the places that holds a positive number."""
    return F.coalesce(*(F.when(p.try_cast("double") > 0, p.try_cast("double")) for p in places))


def on_reference_clock(start: Column, reference_start: Column, offset: Column, duration: Column) -> Column:
    """Bounds of a window on the reference recording's clock: by both start times, else by the stream's offset."""
    low = F.coalesce((F.unix_micros(start) - F.unix_micros(reference_start)) / 1e6, offset)
    return F.struct(low.alias("start_s"), (low + duration).alias("end_s"))


def of_generation(events: DataFrame, generation: str, current: int) -> DataFrame:
    """Events of the current session: late ones of an older session are left out."""
    return events.where(F.col(generation) == current)


def as_of_cursor(rows: DataFrame, keys: list[str], order: list[str], at: str, cursor: Column) -> DataFrame:
    """The last row of each timeline that a session's cursor has passed."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.where(F.col(at) <= cursor).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replayed(spark: SparkSession, stream: DataFrame, sink: Callable[[DataFrame, int], None], state: str) -> None:
    """Drives a bounded stream through a sink, batch by batch, exactly once by its checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def finding_text(label: Column, probability: Column, positive: float = 0.5) -> Column:
    """A finding in words: name, share and how sure."""
    return F.concat(label, F.lit(" ("), F.format_string("%.1f", probability * 100), F.lit(" %"), F.when(probability >= positive, "").otherwise(", uncertain"), F.lit(")"))


def check_config(width_s: float, stride_s: float, share: float) -> None:
    """Refuses windows that cannot be: width and stride must be positive, the share in (0, 1]."""
    if width_s <= 0 or stride_s <= 0:
        raise ValueError("width and stride must be positive")
    if not 0 < share <= 1:
        raise ValueError("the share must be in (0, 1]")
