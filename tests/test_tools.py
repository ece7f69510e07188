"""The named queries through their envelope, and the classifier."""

from __future__ import annotations

import json
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from pulsegrain.operators import learn
from pulsegrain.plans import tools
from pulsegrain.sources import clinical

LINES = [
    {"state_id": "ic-0", "dataset": "icentia11k", "subject_id": "p001", "recording_id": "seg00", "window_index": 0, "window_start_s": 0, "window_end_s": 30, "hr_bpm": 70, "rhythm_class": "N", "window_duration_s": 30},
    {"state_id": "ic-1", "dataset": "icentia11k", "subject_id": "p001", "recording_id": "seg00", "window_index": 1, "window_start_s": 30, "window_end_s": 60, "hr_bpm": 80, "rhythm_class": "AF", "af_burden_ratio": 0.5, "window_duration_s": 30},
    {"state_id": "ic-2", "dataset": "icentia11k", "subject_id": "p001", "recording_id": "seg00", "window_index": 2, "window_start_s": 60, "window_end_s": 90, "hr_bpm": 220, "rhythm_class": "AF", "af_burden_ratio": 1.0, "window_duration_s": 30},
    {"state_id": "we-0", "dataset": " Zenodo", "subject_id": "S11", "window_index": 0, "window_start_s": 0, "window_end_s": 30, "stress_label": "stress", "window_duration_s": 30, "unknown_field": 1},
]


def test_state_tools(spark, tmp_path):
    path = tmp_path / "states.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [*LINES, LINES[0]]) + "\n\n")
    s = tools.Session(spark)
    assert s.call("state_load_monitoring_states", state_path=str(path))["data"]["states"] == 4
    assert {c["dataset"] for c in s.call("state_list_contexts")["data"]} == {"icentia11k", "afppgecg"}
    ic = {"dataset": "icentia11k"}
    now = lambda t: s.call("state_get_current_monitoring_state", timestamp_s=t, **ic)["data"]["state_id"]
    assert (now(35), now(95), now(None)) == ("ic-1", "ic-2", "ic-2")
    assert not s.call("state_get_current_monitoring_state", timestamp_s=1)["success"]
    assert s.call("state_get_monitoring_window", start_s=0, end_s=45, limit=1, **ic)["data"]["total_count"] == 2
    assert s.call("state_get_previous_monitoring_state", state_id="ic-2", offset=2)["data"]["state_id"] == "ic-0"
    trend = s.call("state_get_longitudinal_trend", target="af_burden", **ic)["data"]["rows"][0]
    assert trend["mean_burden"] == 0.75 and trend["latest_burden"] == 1.0 and abs(trend["label_fraction"] - 2 / 3) < 1e-9
    assert not s.call("state_get_longitudinal_trend", target="stress_burden", **ic)["success"]
    assert s.call("state_get_dataset_capabilities", dataset="icentia11k")["data"]["capabilities"]["af_burden"]
    assert s.call("state_get_dataset_capabilities", dataset="nowhere")["data"]["capabilities"] == {}
    replay = s.call("evaluate_proactive_rules", **ic)["data"]
    assert replay["first_triggers"][0]["rule_id"] == "extreme_tachycardia" and replay["alerts"] == 1
    assert not s.call("no_such_tool")["success"]


def test_context_tools(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    alerts = [{"alert_id": k, "urgency": "medium", "triggered_rules": ["sustained_tachycardia"], "reason": "r", "is_false_alert": k == 2} for k in (1, 2)]
    path.write_text("\n".join(json.dumps(x) for x in ({"record_type": "window", "patient_id": "p"}, {"record_type": "patient_context", "patient_id": "p", "alerts": alerts})))
    s = tools.Session(spark)
    assert s.call("proactive_load_patient_context", context_path=str(path))["data"]["contexts"] == 1
    assert [a["alert_id"] for a in s.call("proactive_get_recent_alerts", include_false_alerts=False)["data"]] == [1]
    assert "sustained_tachycardia" in s.call("proactive_explain_last_alert")["data"]["explanation"]
    assert s.call("proactive_list_patient_contexts")["data"] == ["p"]


def test_recording_tools(spark):
    t = np.arange(0, 20, 1 / 50)
    s = tools.Session(spark)
    s.recordings = spark.createDataFrame([("r1", "uploaded", 50.0, (np.sin(2 * np.pi * 1.2 * t) + 2).tolist(), {"lead": "I"})], "record_id string, source string, sampling_rate double, signal array<double>, metadata map<string,string>")
    assert abs(s.call("analyze_heart_rate", record_id="r1")["data"]["mean_hr"] - 72) < 1
    assert s.call("analyze_hrv", record_id="r1")["data"]["rmssd_ms"] < 40
    assert s.call("assess_signal_quality", record_id="r1")["data"]["usability"] == "usable"
    assert abs(s.call("assess_ppg_signal_quality", record_id="r1")["data"]["dominant_frequency"][0] - 1.2) < 0.1
    assert s.call("analyze_ppg_rhythm_irregularity", record_id="r1")["data"] == {"irregular": False, "rhythm": "N"}
    assert s.call("state_build_from_ecg_record", record_id="r1")["success"] and s.call("state_list_contexts")["data"][0]["dataset"] == "uploaded"
    assert not s.call("get_ecg_metadata", record_id="zz")["success"] and "20.0 s" in s.call("get_ecg_description", record_id="r1")["data"]


def beat(rate: float, n: int, r: float = 1.0, st: float = 0.0) -> list[float]:
    t = np.arange(0, n, 1 / rate) % 1.0
    bump = lambda c, w, a: a * np.exp(-(((t - c) / w) ** 2))
    return (bump(0.30, 0.02, 0.15) + bump(0.46, 0.008, -0.02) + bump(0.48, 0.012, r) + bump(0.50, 0.008, -0.05) + bump(0.75, 0.04, 0.3) + st * ((t > 0.53) & (t < 0.66))).tolist()


def test_morphology_tools(spark):
    s = tools.Session(spark)
    rows = [("x", "uploaded", 500.0, beat(500.0, 12), {"lead": "II"})] + [(f"m:{lead}", "clinical", 500.0, beat(500.0, 12, 0.4 + 0.2 * k, 0.2 if lead == "V2" else 0.0), {"lead": lead, "of": "m"}) for k, lead in enumerate(["V1", "V2", "V3", "V4"])]
    s.recordings = spark.createDataFrame(rows, "record_id string, source string, sampling_rate double, signal array<double>, metadata map<string,string>")
    got = s.call("analyze_morphology", record_id="x")["data"]
    assert 40 < got["qrs_ms"] < 120 and 120 < got["pr_ms"] < 220 and got["findings"] == []
    lead = s.call("analyze_lead_morphology", record_id="m")["data"]
    assert [r["lead"] for r in lead["leads"]] == ["V1", "V2", "V3", "V4"] and lead["r_progression"] == "normal"
    assert "st_elevation" in lead["leads"][1]["findings"] and "st_elevation" not in lead["leads"][0]["findings"]
    assert not s.call("analyze_lead_morphology", record_id="m", leads="V9")["success"]
    assert s.call("assess_all_leads_quality", record_id="m")["data"]["overall"]["leads"] == 4


def test_clinical_sources(spark, tmp_path):
    (tmp_path / "i.csv").write_text("ecg_id,sex,scp_codes\n1,1,\"{'IMI': 100.0, 'SR': 0.0}\"\n2,0,\"{'SR': 0.0}\"\n")
    (tmp_path / "s.csv").write_text(",diagnostic,diagnostic_class\nIMI,1.0,MI\nSR,,\n")
    got = {r["ecg_id"]: (r["classes"], r["sex_text"]) for r in clinical.read_index(spark, str(tmp_path / "i.csv"), str(tmp_path / "s.csv")).collect()}
    assert got == {"1": (["MI"], "female"), "2": ([], "male")}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>age</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2"><v>61</v></c></row></sheetData></worksheet>')
    assert clinical.read_sheet(spark, str(tmp_path / "b.xlsx")).collect() == [("7", "61")]
    clinical.convert_payload({b"signal": {"wrist": {"BVP": np.zeros((4, 1))}}, "subject": "S1"}, "S1", str(tmp_path / "p.parquet"))
    assert spark.read.parquet(str(tmp_path / "p.parquet")).first()["channel"] == "signal.wrist.BVP"
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "r9.json").write_text("{}")
    assert clinical.uploaded(spark, str(tmp_path / "up"), 5).first()["record_id"] == "r9"


def test_classifier(spark):
    rng = random.Random(1)
    rows = [(k % 3, float(y), rng.gauss(3 * y, 1), rng.gauss(0, 1), 0.9) for k in range(150) for y in (0, 1)]
    df = spark.createDataFrame(rows, "subject int, label double, a double, b double, share double")
    assert learn.clean_windows(df, "label", "share", 0.8, ["subject"], "a", 10).count() == 60
    got = learn.leave_one_out(df, ["a", "b"], "label", "subject", trees=10, depth=3)
    assert got.count() == 3 and got.agg(F.min("accuracy")).first()[0] > 0.8
