"""Named queries over signals, on recordings made here."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrain.operators import learn, replay
from pulsegrain.operators import wearables as we
from pulsegrain.plans import tools, tools_signal
from pulsegrain.sources import wfdb
from pulsegrain.streaming import live

CHANNELS = "subject string, channel string, samples array<double>, width int"


def wave(hz: float, seconds: float, rate: float) -> list[float]:
    return np.sin(2 * np.pi * hz * np.arange(0, seconds, 1 / rate)).tolist()


def subject(name: str, seed: int, seconds: int = 240) -> list[tuple]:
    """The first half is baseline, slow; the second stress, fast."""
    rng, half = np.random.default_rng(seed), seconds / 2
    acc = (rng.normal(0, 1, (seconds * 32, 3)) + [0, 0, 64]).ravel()
    return [
        (name, "label", [1.0] * int(half * 700) + [2.0] * int(half * 700), 1),
        (name, "signal.wrist.BVP", wave(1.0, half, 64) + wave(2.0, half, 64), 1),
        (name, "signal.wrist.ACC", acc.tolist(), 3),
        (name, "signal.wrist.EDA", np.linspace(1, 2, seconds * 4).tolist(), 1),
        (name, "signal.wrist.TEMP", [33.0] * (seconds * 4), 1),
        (name, "activity", [1.0] * int(half * 4) + [7.0] * int(half * 4), 1),
        (name, "hr", [60.0] * int(half / 2) + [120.0] * int(half / 2), 1),
    ]


@pytest.fixture(scope="module")
def session(spark):
    s = tools.Session(spark)
    s.wearables = spark.createDataFrame([r for k, n in enumerate(["S1", "S2", "S3"]) for r in subject(n, k)], CHANNELS).cache()
    rr = np.r_[np.full(200, 200), np.random.default_rng(1).integers(80, 320, 200)]  # regular, then irregular, at 250 Hz
    qrs = np.cumsum(rr)
    s.references = spark.createDataFrame([("007", 250.0, int(qrs[-1]) + 100, qrs.tolist(), [0] * 200 + [1] * 200)], "patient string, rate double, n_samples long, qrs array<long>, labels array<int>")
    return s


def test_almost_every_tool_is_there():
    assert len(tools.names()) >= 39


def test_sessions_are_restricted_and_emptied(session, spark, tmp_path):
    s = tools.Session(spark)
    s.wearables = session.wearables
    path = str(tmp_path / "s3.parquet")
    session.wearables.where("subject = 'S3'").write.parquet(path)
    assert s.call("state_build_from_wesad_pickle", pickle_path=path)["data"]["states"] == 4
    assert s.analyse("wesad", subject_id="S3", window_start_s=0, window_end_s=30)["success"] and not s.analyse("other")["success"]
    assert "classify_wesad_stress_state" in s.restrict("wesad") and not s.call("list_ecg_records")["success"]
    assert s.restrict("wesad", ("state",)) and not s.call("analyze_wesad_window_signal", subject_id="S3", window_start_s=0, window_end_s=30)["success"]
    s.hide_label_fields()
    assert s.states.where("stress_label IS NOT NULL").count() == 0
    s.keep_only(s.states.orderBy("window_index").limit(1).select("state_id"))
    assert s.states.count() == 1
    s.clear()
    assert s.states.count() == 0


def test_configurations_that_cannot_be():
    replay.check_config(30, 15, 0.8)
    for wrong in ((0, 15, 0.8), (30, -1, 0.8), (30, 15, 0.0), (30, 15, 1.1)):
        with pytest.raises(ValueError, match="must be"):
            replay.check_config(*wrong)


def test_a_live_session_hands_each_row_on_once(spark, tmp_path):
    for k in range(5):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen: list[int] = []
    live_session = live.LiveSession(spark, "id long", str(tmp_path / "in"), lambda batch, n: seen.extend(r[0] for r in batch.collect()), str(tmp_path / "state"), seconds=0.2)
    live_session.start()
    live_session.wait_for(1)
    live_session.pause()
    paused = len(seen)
    assert paused >= 10 and not live_session.snapshot()["running"]
    live_session.set_speed(4.0)
    live_session.fast_forward()
    assert sorted(seen) == list(range(50)) and live_session.snapshot()["generation"] == 2
    with pytest.raises(ValueError, match="positive"):
        live_session.set_speed(0)


def test_wearable_windows(session):
    got = session.call("analyze_wesad_window_signal", subject_id="S1", window_start_s=130, window_end_s=190)["data"]
    assert abs(got["bvp_pulse"]["mean_bpm"] - 120) < 3 and got["protocol_label"] == {"label_id": 2, "label": "stress", "fraction": 1.0, "clean": True}
    assert got["temperature"]["mean"] == 33.0 and got["eda"]["slope_per_s"] > 0 and "respiration" not in got and got["motion_level"] in ("low", "medium")
    dalia = session.call("analyze_ppg_dalia_window_signal", patient_id="S2", window_start_s=30, window_end_s=90)["data"]
    assert dalia["activity"]["label"] == "sitting" and dalia["ecg_reference_hr"]["mean"] == 60.0
    mixed = session.call("analyze_wesad_window_signal", subject_id="S1", window_start_s=110, window_end_s=130)["data"]["protocol_label"]
    assert mixed["label_id"] == 1 and not mixed["clean"]
    assert not session.call("analyze_wesad_window_signal", subject_id="S1", window_start_s=9, window_end_s=9)["success"]
    assert not session.call("analyze_wesad_window_signal", subject_id="S9", window_start_s=1, window_end_s=9)["success"]


def test_features_equal_numpy(session, spark):
    windows = spark.createDataFrame([("S1", 10.0, 40.0), ("S1", 9000.0, 9030.0), ("none", 0.0, 30.0)], "subject string, start_s double, end_s double")
    got = {(r["subject"], r["start_s"]): r for r in we.features(session.wearables, windows).collect()}
    held = {r["channel"]: np.array(r["samples"]) for r in session.wearables.where("subject = 'S1'").collect()}
    r = got["S1", 10.0]
    bvp, mag = held["signal.wrist.BVP"][640:2560], np.linalg.norm(held["signal.wrist.ACC"].reshape(-1, 3)[320:1280], axis=1)
    want = {"bvp_std": bvp.std(), "bvp_diff_std": np.diff(bvp).std(), "bvp_dom_hr_bpm": 60.0, "acc_mag_mean": mag.mean(), "acc_diff_abs_mean": np.abs(np.diff(mag)).mean(), "temp_mean": 33.0, "resp_mean": 0.0, "eda_slope_per_s": (held["signal.wrist.EDA"][159] - held["signal.wrist.EDA"][40]) / 30}
    assert all(abs(r[k] - v) < 1e-6 for k, v in want.items())
    assert all(got["S1", 9000.0][f] == 0 == got["none", 0.0][f] for f in we.FEATURES)


def test_state_builders(session, spark, tmp_path):
    s = tools.Session(spark)
    s.references = session.references
    path = str(tmp_path / "s1.parquet")
    session.wearables.where("subject = 'S1'").write.parquet(path)
    assert s.call("state_build_from_wesad_pickle", pickle_path=path, window_secs=30)["data"]["states"] == 8
    assert s.call("state_build_from_ppg_dalia_pickle", pickle_path=path, max_windows=6)["data"]["states"] == 6
    assert s.call("state_build_from_ppg_patient", patient_id="007", window_sec=40)["success"]
    by = {d: s.states.where(F.col("dataset") == d).orderBy("window_index").collect() for d in ("wesad", "ppg_dalia", "afppgecg")}
    assert [r["stress_label"] for r in by["wesad"]] == ["baseline"] * 4 + ["stress"] * 4 and by["wesad"][4]["previous_stress_label"] == "baseline"
    assert [(r["activity_label"], r["hr_bpm"]) for r in by["ppg_dalia"]] == [("sitting", 60.0)] * 4 + [("walking", 120.0)] * 2 and by["ppg_dalia"][0]["stress_label"] is None
    assert [r["rhythm_class"] for r in by["afppgecg"]] == ["N"] * 4 + ["AF"] * (len(by["afppgecg"]) - 4)
    assert not s.call("state_build_from_ppg_patient", patient_id="008")["success"]


def test_missing_contexts_are_built_once(session, spark, tmp_path):
    s = tools.Session(spark)
    path = str(tmp_path / "s2.parquet")
    session.wearables.where("subject = 'S2'").write.parquet(path)
    s.manifest, s.hide_labels = [{"dataset": "wesad", "subject_id": "S2", "tool": "state_build_from_wesad_pickle", "arguments": {"pickle_path": path}}], True
    ask = lambda subject_id: s.call("eval_state_build_missing_context", dataset="wesad", subject_id=subject_id)
    first = ask("S2")["data"]
    assert not first["cached"] and first["states"] == 4 and ask("S2")["data"] == {"cached": True, "states": 4}
    assert s.states.where("stress_label IS NOT NULL").count() == 0 and not ask("S3")["success"]


def test_rhythm_context(session):
    got = session.call("analyze_afppgecg_rhythm_context", patient_id="007", anchor_window_start_s=5, anchor_window_end_s=65, n_sampled_chunks=20)["data"]
    assert got["anchor_window_summary"]["rhythm_label"] == "N" and got["anchor_window_summary"]["irregularity_metrics"]["mean_rr_ms"] == 800.0
    more = got["extended_context_summary"]
    assert more["n_sampled_chunks"] == 20 and more["af_chunk_count"] > 5 and more["sustained_af_evidence"] and more["transition_count"] >= 1
    assert "extended_context_summary" not in session.call("analyze_afppgecg_rhythm_context", patient_id="007", window_start_s=5, window_end_s=65, scope="locator_window")["data"]
    assert not session.call("analyze_afppgecg_rhythm_context", patient_id="007", window_start_s=5, window_end_s=65, scope="all")["success"]


def test_segment_windows(spark, tmp_path):
    beats = [(k, "N", "") for k in range(25, 50 * 120, 50)]
    wfdb.write_record(tmp_path, "p1_s00", 50, {"II": np.abs(wave(0.5, 120, 50)).tolist()}, beats)
    s = tools.Session(spark)
    got = s.call("analyze_icentia11k_ecg_window_signal", patient_id="p1", segment_id="s00", window_start_s=30, window_end_s=90, local_root=str(tmp_path))["data"]
    assert got["heart_rate"] == {"mean_bpm": 60.0, "max_30s_bpm": 60.0, "min_30s_bpm": 60.0, "monitoring_context_max_30s_bpm": 60.0} and (got["sample_start"], got["sample_end"]) == (1500, 4500)
    assert not s.call("analyze_icentia11k_ecg_window_signal", patient_id="p1", segment_id="s00", window_start_s=500, window_end_s=560, local_root=str(tmp_path))["success"]


def test_stress_classifier_life_cycle(session, spark, tmp_path):
    got = session.call("classify_wesad_stress_state", subject_id="S3", window_start_s=130, window_end_s=190)["data"]
    assert got["stress_state"] == "stress" and got["train_subjects"] == ["S1", "S2"] and abs(sum(got["probabilities"].values()) - 1) < 1e-9
    assert not session.call("classify_wesad_stress_state", subject_id="S3", window_start_s=0, window_end_s=60, train_subject_ids=["S3"])["success"]
    rows = tools_signal.stress_training_rows(session.wearables.where("subject <> 'S3'"))
    learn.save(learn.train(rows, we.FEATURES, "y", trees=5), str(tmp_path / "m"), {"train_subjects": ["S1", "S2"], "classes": ["baseline", "stress"]})
    use = lambda subject_id: session.call("classify_wesad_stress_state", subject_id=subject_id, window_start_s=0, window_end_s=60, model_path=str(tmp_path / "m"))
    assert use("S3")["data"]["stress_state"] == "baseline" and "trained on this subject" in use("S1")["error"]


def test_diagnosis_is_what_the_given_model_says(session, spark):
    s = tools.Session(spark)
    s.recordings = spark.createDataFrame([("r", "clinical", 500.0, [0.0], {"age": "70", "classes": "MI,CD"}), ("q", "uploaded", 500.0, [0.0], {"age": "x"})], "record_id string, source string, sampling_rate double, signal array<double>, metadata map<string,string>")
    assert not s.call("ecg_diagnosis", record_id="r")["success"]
    s.diagnose = lambda rows, mode: rows.select(F.explode(F.create_map(F.lit("AF"), F.lit(0.9), F.lit("VT"), F.lit(0.05), F.lit("SR"), F.lit(0.2))).alias("label", "probability"))
    assert [f["label"] for f in s.call("ecg_diagnosis", record_id="r")["data"]["findings"]] == ["AF", "SR"]
    assert [r["record_id"] for r in s.call("list_ecg_records")["data"]] == ["q", "r"]
    assert [r["record_id"] for r in s.call("list_ecg_records", age_min=60, diagnostic_class="CD")["data"]] == ["r"]
