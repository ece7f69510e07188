"""Builders of monitoring states: fixed windows over recordings, joined with beats, spans or labels.

Positions are integer samples.  All joins are interval joins on (subject, recording); segment aggregates
are computed once per recording and joined back to its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrain.schema import STATE

from . import intervals as iv
from . import windowing as wn

KEYS = ["subject_id", "recording_id"]
#: Which rhythm wins a tie of overlap, and which protocol label one of duration.
RHYTHM_PRIORITY = {"AF": 3, "AFL": 2, "N": 1}
STRESS_PRIORITY = {"stress": 4, "amusement": 3, "meditation": 2, "baseline": 1}


def _as_states(rows: DataFrame, dataset: str, modality: str) -> DataFrame:
    """The rows under the state schema; what they lack is null."""
    named = rows.withColumns({"dataset": F.lit(dataset), "modality": F.lit(modality), "patient_id": F.col("subject_id"), "state_id": F.format_string(f"{dataset}_%s_%s_%06d", "subject_id", "recording_id", "window_index"), "alert_triggered": F.lit(False)})
    return named.select(*((F.col(f.name).cast(f.dataType) if f.name in named.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in STATE.fields))


def _windows(recordings: DataFrame, width: int, stride: int) -> DataFrame:
    grid = wn.grid(recordings, "start", "end", width, stride)
    return grid.withColumn("window_index", ((F.col("window_start") - F.col("start")) / stride).cast("int"))


def rhythm_states(recordings: DataFrame, beats: DataFrame, spans: DataFrame, rate: Column, dataset: str, width: int, sub: int, min_overlap: int = 0, stride: int | None = None) -> DataFrame:
    """States of annotated recordings (subject_id, recording_id, start, end).

    beats: (keys, sample); spans: (keys, span_start, span_end, label).  Heart rate counts beats over the
    window, the highest over its sub-windows (empty ones left out, a short last one with its own
    duration); rhythm is the label with the longest overlap of spans that overlap by at least
    min_overlap; burden is over annotated time.  Without beats or labels a value is null, not 0.
    """
    stride = stride or width
    grid = _windows(recordings.withColumn("_rate", rate), width, stride)
    per = [*KEYS, "window_start"]
    inside = iv.contained_points(beats, grid, KEYS, "sample", ("window_start", "window_end"), width)
    minutes = lambda n: n / F.col("_rate") / 60.0
    counted = inside.groupBy(*per, "_rate", F.floor((F.col("sample") - F.col("window_start")) / sub).alias("_sub")).agg(F.count(F.lit(1)).alias("_n"))
    length = F.least(F.lit(sub), F.lit(width) - F.col("_sub") * sub)
    rates = counted.groupBy(*per).agg(F.sum("_n").alias("_beats"), F.max(F.try_divide("_n", minutes(length))).alias("max_hr_bpm"))
    overlaps = iv.overlap_join(grid, spans.withColumn("label", F.when(F.col("label") == "AFL", "AF").otherwise(F.col("label"))), KEYS, ("window_start", "window_end"), ("span_start", "span_end"), width)
    long_enough = overlaps.where((F.col("overlap_end") - F.col("overlap_start")) >= min_overlap)
    dominant = iv.best_label(overlaps, per, "label", RHYTHM_PRIORITY, min_overlap).withColumnRenamed("dominant", "rhythm_class")
    share = iv.burden(overlaps, per, "label", "AF", F.lit(width)).select(*per, F.col("annotated_burden").alias("af_burden_ratio"))
    w = Window.partitionBy(*per).orderBy("overlap_start")
    flips = long_enough.withColumn("_before", F.lag("label").over(w)).groupBy(*per).agg(F.count_if(F.col("_before") != F.col("label")).alias("rhythm_transition_count"))
    joined = grid.join(rates, per, "left").join(dominant, per, "left").join(share, per, "left").join(flips, per, "left")
    line = Window.partitionBy(*KEYS).orderBy("window_index")
    hr = F.try_divide(F.nullif("_beats", F.lit(0)), minutes(F.lit(width)))
    done = joined.withColumns({"hr_bpm": hr, "window_start_s": F.col("window_start") / F.col("_rate"), "window_duration_s": F.lit(width) / F.col("_rate")})
    done = done.withColumn("rhythm_transition_count_per_hour", F.coalesce("rhythm_transition_count", F.lit(0)) / (F.col("window_duration_s") / 3600.0))
    if stride == width:
        done = done.withColumns({"previous_hr_bpm": F.lag("hr_bpm").over(line), "previous_rhythm_class": F.lag("rhythm_class").over(line)})
    totals = done.groupBy(*KEYS).agg(F.avg("hr_bpm").alias("mean_hr_bpm"), F.max(F.col("window_start_s") + F.col("window_duration_s")).alias("_last"), F.min("window_start_s").alias("_first"))
    return _as_states(done.join(totals, KEYS).withColumn("recording_duration_s", F.col("_last") - F.col("_first")), dataset, "ecg")


def label_states(labels: DataFrame, dataset: str, rate: float, width: int, names: dict[int, str], min_share: float = 0.8, hr: DataFrame | None = None) -> DataFrame:
    """States of labelled wearables: labels are (keys, sample, label id).

    A window stays if its most frequent label (ties: the smallest id) is an allowed one and holds
    min_share of it; the previous state is the one before among those that stay, whatever the gap.
    hr: optional (keys, sample, bpm) whose mean is the window's rate.
    """
    placed = labels.withColumn("window_index", F.floor(F.col("sample") / width).cast("int"))
    whole = placed.groupBy(*KEYS, "window_index").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == width).select(*KEYS, "window_index")
    found = iv.mode_smallest(placed, [*KEYS, "window_index"], "label").join(whole, [*KEYS, "window_index"], "left_semi").where(F.col("mode").isin(list(names)) & (F.col("fraction") >= min_share))
    text = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("mode")]
    kept = found.withColumns({"stress_label": text, "protocol_label_id": F.col("mode"), "window_start_s": F.col("window_index") * width / F.lit(rate), "window_duration_s": F.lit(width / rate)})
    if hr is not None:
        mean = hr.withColumn("window_index", F.floor(F.col("sample") / width).cast("int")).groupBy(*KEYS, "window_index").agg(F.avg("bpm").alias("hr_bpm"), F.max("bpm").alias("max_hr_bpm"))
        kept = kept.join(mean, [*KEYS, "window_index"], "left")
    line = Window.partitionBy(*KEYS).orderBy("window_index")
    kept = kept.withColumns({"previous_stress_label": F.lag("stress_label").over(line), "previous_protocol_label_id": F.lag("protocol_label_id").over(line)})
    place = F.create_map(*(F.lit(x) for kv in STRESS_PRIORITY.items() for x in kv))[text]
    each = placed.where(F.col("label").isin(list(names))).withColumn("mode", F.col("label")).groupBy(*KEYS, text.alias("_t")).agg(F.count(F.lit(1)).alias("_d"), F.first(place).alias("_p"))
    total = each.groupBy(*KEYS).agg(F.max_by("_t", F.struct("_d", "_p")).alias("dominant_stress_label"), (F.coalesce(F.sum(F.when(F.col("_t") == "stress", F.col("_d"))), F.lit(0)) / F.lit(rate)).alias("stress_duration_s"), (F.sum("_d") / F.lit(rate)).alias("recording_duration_s"))
    total = total.withColumn("stress_burden_ratio", F.try_divide("stress_duration_s", "recording_duration_s"))
    return _as_states(kept.join(total, KEYS, "left"), dataset, "wearable")
