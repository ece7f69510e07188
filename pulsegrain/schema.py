"""The monitoring-state row, its vocabularies and its effective keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of data set names.
DATASET_ALIASES = {"af_ppg_ecg": "afppgecg", "zenodo": "afppgecg", "zenodo_af_monitoring": "afppgecg"}
RHYTHMS = ("N", "AF", "Other", "Unknown")
URGENCY = ("none", "low", "medium", "high", "critical")

STRING, DOUBLE, INT, BOOL, MAP = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.MapType(T.StringType(), T.StringType())

#: Field order of a state; everything but the identity may be null.
FIELDS: list[tuple[str, T.DataType]] = [
    *((n, STRING) for n in ("state_id", "patient_id", "dataset", "modality", "subject_id", "recording_id")),
    ("window_index", INT),
    *((n, DOUBLE) for n in ("window_start_s", "window_end_s", "window_duration_s", "hr_bpm")),
    ("rhythm_class", STRING),
    ("stress_label", STRING),
    ("protocol_label_id", INT),
    ("activity_label", STRING),
    ("previous_hr_bpm", DOUBLE),
    ("previous_rhythm_class", STRING),
    ("previous_stress_label", STRING),
    ("previous_protocol_label_id", INT),
    ("previous_activity_label", STRING),
    ("dataset_specific", MAP),
    ("af_burden_ratio", DOUBLE),
    ("stress_burden_ratio", DOUBLE),
    ("stress_duration_s", DOUBLE),
    ("dominant_stress_label", STRING),
    *((n, DOUBLE) for n in ("max_hr_bpm", "mean_hr_bpm", "ecg_reference_hr_bpm", "rhythm_transition_count_per_hour", "stress_transition_count_per_hour")),
    *((n, DOUBLE) for n in ("mean_hr_5min", "tachycardia_ratio_5min", "af_episode_duration_s", "sdnn_ms", "rmssd_ms", "signal_quality_score")),
    ("motion_level", STRING),
    ("baseline_resting_hr", DOUBLE),
    ("hr_deviation_from_baseline", DOUBLE),
    ("rhythm_transition_count", INT),
    ("stress_transition_count", INT),
    ("recording_duration_s", DOUBLE),
    ("alert_triggered", BOOL),
    ("alert_rule", STRING),
    ("alert_reason", STRING),
    ("urgency", STRING),
    ("metadata", MAP),
]
STATE = T.StructType([T.StructField(name, kind) for name, kind in FIELDS])


def canonical_dataset(name: Column) -> Column:
    """Trimmed, lower-cased, aliases resolved."""
    plain = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in DATASET_ALIASES.items() for x in kv))[plain], plain)


def _filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def with_effective_keys(states: DataFrame) -> DataFrame:
    """Adds eff_subject, eff_recording, eff_start, eff_end and eff_duration by the documented fallbacks."""
    meta = lambda k: F.col("metadata")[k]
    number = lambda k: meta(k).try_cast("double")
    subject = _filled(F.col("subject_id"), meta("subject_id"), F.col("dataset_specific")["subject_id"], F.col("patient_id"))
    recording = _filled(F.col("recording_id"), meta("recording_id"), meta("record_id"), meta("segment_id"), subject)
    start = F.coalesce("window_start_s", number("window_start_s"))
    end = F.coalesce(F.col("window_end_s"), number("window_end_s"), start + F.col("window_duration_s"))
    return states.withColumns({"eff_subject": subject, "eff_recording": recording, "eff_start": start, "eff_end": end}).withColumn(
        "eff_duration", F.coalesce(F.col("window_duration_s"), F.col("eff_end") - F.col("eff_start"), F.lit(0.0))
    )
