"""State builders on small recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrain.operators import builders as bd


def test_rhythm_states(spark):
    recordings = spark.createDataFrame([("p", "r", 0, 650)], "subject_id string, recording_id string, start long, end long")
    beats = spark.createDataFrame([("p", "r", s) for s in range(0, 300, 10)], "subject_id string, recording_id string, sample long")
    spans = spark.createDataFrame([("p", "r", 0, 150, "N"), ("p", "r", 150, 300, "AFL"), ("p", "r", 300, 301, "N")], "subject_id string, recording_id string, span_start long, span_end long, label string")
    got = bd.rhythm_states(recordings, beats, spans, F.lit(10.0), "icentia11k", 300, 120, 2).orderBy("window_index").collect()
    assert len(got) == 2
    a, b = got
    assert (a["hr_bpm"], a["max_hr_bpm"], a["rhythm_class"], a["af_burden_ratio"], a["rhythm_transition_count"]) == (60.0, 60.0, "AF", 0.5, 1)
    assert b["hr_bpm"] is None and b["rhythm_class"] is None and b["previous_rhythm_class"] == "AF" and b["af_burden_ratio"] == 0.0
    assert a["state_id"] == "icentia11k_p_r_000000" and a["rhythm_transition_count_per_hour"] == 120.0


def test_label_states(spark):
    ids = [1] * 10 + [1] * 5 + [2] * 5 + [2] * 10 + [9] * 10 + [2] * 4
    labels = spark.createDataFrame([("s", "s", k, v) for k, v in enumerate(ids)], "subject_id string, recording_id string, sample long, label int")
    got = bd.label_states(labels, "wesad", 1.0, 10, {1: "baseline", 2: "stress"}).orderBy("window_index").collect()
    assert [(r["window_index"], r["stress_label"], r["previous_stress_label"]) for r in got] == [(0, "baseline", None), (2, "stress", "baseline")]
    assert got[0]["dominant_stress_label"] == "stress" and got[0]["stress_duration_s"] == 19.0
    assert bd.label_states(labels.limit(0), "wesad", 1.0, 10, {1: "baseline"}).count() == 0
