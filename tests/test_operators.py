"""Operators on small inputs with results worked out by hand."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrain import schema
from pulsegrain.functions import signal as sg
from pulsegrain.functions import records as rc
from pulsegrain.functions import text as tx
from pulsegrain.functions import vitals as vt
from pulsegrain.operators import annotations as an
from pulsegrain.operators import drift as dr
from pulsegrain.operators import evaluate as ev
from pulsegrain.operators import intervals as iv
from pulsegrain.operators import monitoring as mo
from pulsegrain.operators import rules as rl
from pulsegrain.operators import sampling as sm
from pulsegrain.operators import sequence as seq
from pulsegrain.operators import state as st
from pulsegrain.operators import tracker as tr
from pulsegrain.operators import windowing as wn
from pulsegrain.sources import records, wfdb
from pulsegrain.streaming.tracker_stream import Memory

STATES = [
    ("ic-0", "icentia11k", "p001", "seg00", 0.0, 30.0, 0, 70.0, "N", None),
    ("ic-1", "icentia11k", "p001", "seg00", 30.0, 60.0, 1, 80.0, "AF", 0.5),
    ("ic-2", "icentia11k", "p001", "seg00", 60.0, 90.0, 2, 90.0, "AF", 1.0),
    ("wesad-0", "wesad", "S11", "S11", 0.0, 30.0, 0, None, None, None),
    ("wesad-1", "wesad", "S11", "S11", 30.0, 60.0, 1, None, None, 1.0),
    ("dalia-0", "ppg_dalia", "S1", "S1", 0.0, 30.0, 0, 72.0, None, None),
    ("dalia-1", "ppg_dalia", "S1", "S1", 30.0, 60.0, 1, 98.0, None, None),
]
KEYS = ["dataset", "subject", "rec"]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(STATES, "state_id string, dataset string, subject string, rec string, s double, e double, idx int, hr double, rhythm string, ratio double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_contexts_and_current(spark, states):
    found = st.contexts(states, KEYS, "idx", "rhythm", "s", "e").orderBy("dataset").collect()
    assert [(r["dataset"], r["state_count"], r["start"], r["end"]) for r in found] == [("icentia11k", 3, 0.0, 90.0), ("ppg_dalia", 2, 0.0, 60.0), ("wesad", 2, 0.0, 60.0)]
    probes = spark.createDataFrame([("icentia11k", "p001", "seg00", t) for t in (35.0, 95.0)], "dataset string, subject string, rec string, at double")
    got = {r["at"]: (r["picked"], r["contains"]) for r in st.current_as_of(states, probes, KEYS, "s", "e", "state_id", "at").collect()}
    assert got == {35.0: ("ic-1", True), 95.0: ("ic-2", False)}


def test_current_prefers_the_first_that_contains(spark):
    rows = spark.createDataFrame([("a", 0, 100, 1), ("a", 10, 20, 2), ("a", None, 5, 3)], "k string, s int, e int, n int")
    probes = spark.createDataFrame([("a", 15), ("a", 50), ("a", 200), ("b", 1)], "k string, at int")
    got = {(r["k"], r["at"]): r["picked"] for r in st.current_as_of(rows, probes, ["k"], "s", "e", "n", "at").collect()}
    assert got[("a", 50)] == 1 and got[("a", 200)] == 2 and got[("b", 1)] is None


def test_overlap_range_and_limit(states):
    assert st.overlapping(states, 30.0, 30.0, "s", "e").count() == 0
    assert {r["state_id"] for r in st.overlapping(states, 30.0, 60.0, "s", "e").collect()} == {"ic-1", "wesad-1", "dalia-1"}
    assert st.with_total(states, ["state_id"], 2).first()["total_count"] == 7
    with pytest.raises(ValueError):
        st.with_total(states, ["state_id"], 0)
    with pytest.raises(ValueError):
        st.require_unambiguous(states, KEYS)


def test_effective_keys(spark):
    row = {f: None for f, _ in schema.FIELDS} | {"state_id": "x", "subject_id": "", "patient_id": "p", "metadata": {"segment_id": "s1", "window_start_s": "5"}, "window_duration_s": 10.0}
    got = schema.with_effective_keys(spark.createDataFrame([tuple(row[f] for f, _ in schema.FIELDS)], schema.STATE)).first()
    assert (got["eff_subject"], got["eff_recording"], got["eff_start"], got["eff_end"], got["eff_duration"]) == ("p", "s1", 5.0, 15.0, 10.0)


def test_debounce_and_runs(spark):
    labels = ["N", "AF", "AF", None, "AF", "N", "N", "N", "Other"]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(labels)], "k string, i int, v string")
    got = [(r["i"], r["from_label"], r["to_label"]) for r in seq.debounced(df, ["k"], ["i"], "v", 3).orderBy("i").collect()]
    assert got == [(1, "N", "AF"), (5, "AF", "N")]
    assert seq.transition_counts(df, ["k"], ["i"], "v").first()["transitions"] == 3
    assert {r["v"]: r["longest"] for r in seq.longest_runs(df, ["k"], ["i"], "v").collect()} == {"N": 3, "AF": 2, "Other": 1}


def test_timer_holds_over_unknown_and_resets(spark):
    df = spark.createDataFrame([("a", i, v, 10) for i, v in enumerate(["AF", None, "AF", "N", "AF", "Other", None])], "k string, i int, v string, d int")
    assert [r["timer"] for r in seq.episode_timer(df, ["k"], ["i"], "v", "d").orderBy("i").collect()] == [10, 10, 20, None, 10, None, None]


def test_tachy_ratio(spark):
    rows = [("a", i, 80.0 if i < 10 else 110.0) for i in range(30)]
    last = seq.exceed_ratio(spark.createDataFrame(rows, "k string, i int, hr double"), ["k"], ["i"], "hr", 100, 30).orderBy(F.desc("i")).first()
    assert last["samples"] == 30 and math.isclose(last["ratio"], 20 / 30)


def test_ema_skips_far_values(spark):
    df = spark.createDataFrame([("a", 0, 70.0), ("a", 1, 150.0), ("a", 2, 74.0)], "k string, i int, hr double")
    assert seq.ema_skip(df, ["k"], ["i"], "hr").first()["baseline"] == 70.2


def test_half_minutes_add_up_exactly(spark):
    """The 600th beat ends at 60 s to the digit, where a sum of doubles stays below."""
    rr = [100.1] * 599 + [60_000 - 59_959.9] + [500.0] * 100
    assert sum(x / 1000 for x in rr[:600]) != 60.0
    rows = [("a", i, x, 95.0) for i, x in enumerate(rr)] + [("b", i, 1000.0, 40.0) for i in range(60)] + [("c", 0, 10_000.0, float("inf")), ("c", 1, float("inf"), float("inf"))]
    found = mo.half_minute_rates(spark.createDataFrame(rows, "k string, i int, rr double, s double"), ["k"], ["i"], "rr", "s")
    got = {(r["k"], r["half_minute"]): r["bpm"] for r in found.collect()}
    assert got == {("a", 0): 600.0, ("a", 1): 600.0, ("a", 2): 120.0, ("b", 0): 60.0, ("c", 0): 4.0}


def test_ema_rounds_the_double(spark):
    """104.1 then 95.1 steps to 103.64999999999999, which rounds as scaling by ten does; so for a grid of starts and steps."""
    cases = [(f"{a}-{b}", i, v / 100) for a in range(10000, 10500, 10) for b in range(a - 1500, a + 1501, 100) for i, v in enumerate((a, b))]
    got = {r["k"]: r["baseline"] for r in seq.ema_skip(spark.createDataFrame(cases, "k string, i int, hr double"), ["k"], ["i"], "hr").collect()}
    far = lambda x: math.floor(x) + (x - math.floor(x) >= 0.5)
    for (k, _, first), (_, _, second) in zip(cases[::2], cases[1::2], strict=True):
        start = far(first * 10) / 10
        assert got[k] == far((start + 0.05 * (second - start)) * 10) / 10


def test_monitoring_aggregate(spark):
    rows = [("a", 0, "AF", 10, 70.0), ("a", 1, "AF", 10, 80.0), ("a", 2, "AF", 10, 90.0), ("a", 3, "N", 10, 60.0)]
    got = tr.summarise(spark.createDataFrame(rows, "k string, i int, v string, d int, hr double"), ["k"], ["i"], "v", "d", "hr", 2).first()
    assert (got["af_burden"], got["max_hr"], got["confirmed"], got["confirmed_duration"], got["transitions"], got["debounced"]) == (0.75, 90.0, 1, 30, 1, 0)
    assert tr.summarise(spark.createDataFrame([], "k string, i int, v string, d int, hr double"), ["k"], ["i"], "v", "d", "hr").count() == 0


def test_beats_to_segments_and_labels(spark):
    beats = spark.createDataFrame([("a", i, i, v) for i, v in enumerate([0, 0, 1, 1])], "k string, n int, at int, v int")
    got = seq.rhythm_segments(beats, ["k"], ["n"], "at", "v").orderBy("seg_start").collect()
    assert [(r["seg_start"], r["seg_end"], r["v"]) for r in got] == [(0, 2, 0), (2, 3, 1)]
    label = lambda b, c: one(spark, iv.window_label(F.lit(b), F.lit(c)))
    assert [label(0.5, True), label(1.0, True), label(0.01, True), label(1.0, False)] == ["transition", "AF", "NSR", "unlabeled"]


def test_overlap_join_counts_a_pair_once(spark):
    left = spark.createDataFrame([("a", 0, 1000, "l")], "k string, ls long, le long, n string")
    right = spark.createDataFrame([("a", 5, 995, "x"), ("a", 1000, 1001, "y"), ("a", 7, 7, "empty"), ("a", None, 9, "null")], "k string, rs long, re long, m string")
    got = iv.overlap_join(left, right, ["k"], ("ls", "le"), ("rs", "re"), 10).collect()
    assert [(r["m"], r["overlap_start"], r["overlap_end"]) for r in got] == [("x", 5, 995)]


def test_dominant_label_tie(spark):
    o = spark.createDataFrame([("w", "N", 0, 5), ("w", "AF", 5, 10)], "k string, v string, overlap_start int, overlap_end int")
    assert iv.best_label(o, ["k"], "v", {"AF": 3, "AFL": 2, "N": 1}).first()["dominant"] == "AF"


def test_rhythm_classifier(spark):
    assert one(spark, vt.classify_rhythm(arr([800.0] * 20))) == "N"
    rng = np.random.default_rng(4)
    assert one(spark, vt.classify_rhythm(arr(rng.uniform(450, 1200, 60)))) == "AF"
    assert one(spark, vt.classify_rhythm(arr([800, 500] * 15))) == "Other"
    assert one(spark, vt.classify_rhythm(arr([800.0] * 4))) == "Unknown"
    assert one(spark, vt.classify_rhythm(F.lit(None).cast("array<double>"))) == "Unknown"


def test_variability(spark):
    rr = [700, 780, 820, 900, 710, 790, 810, 890]
    d = np.diff(rr)
    assert math.isclose(one(spark, vt.sdnn(arr(rr))), np.std(rr, ddof=1))
    assert math.isclose(one(spark, vt.rmssd(arr(rr))), np.sqrt(np.mean(d**2)))
    assert one(spark, vt.sdnn(arr([1, 2]))) is None
    assert one(spark, vt.differences(arr([1]))) == []


def test_rules_and_alerts(spark):
    rows = spark.createDataFrame([("a", 0, 25.0, 10.0), ("a", 1, 25.0, 10.0), ("a", 2, 80.0, 10.0), ("a", 3, 220.0, 10.0), ("a", 4, None, 10.0)], "k string, i int, hr_bpm double, window_s double")
    rows = rows.withColumns({"tachy_samples": F.lit(1), "tachy_ratio": F.lit(0.0), "af_episode_s": F.lit(None).cast("double")})
    judged = rl.evaluate(rows, rl.rules_for("ecg"))
    assert [r["triggered"] for r in judged.orderBy("i").collect()] == [["extreme_bradycardia"], ["extreme_bradycardia"], [], ["extreme_tachycardia"], []]
    assert [r["i"] for r in rl.alerts(judged, ["k"], ["i"]).orderBy("i").collect()] == [0, 3]
    assert len(rl.rules_for("ecg", staged=True)) == 4


def test_matching(spark):
    truth = spark.createDataFrame([("a", 10, "AF"), ("a", 50, "N")], "k string, t int, v string")
    pred = spark.createDataFrame([("a", 5, "AF"), ("a", 12, "N"), ("a", 20, "AF"), ("a", 30, "AF"), ("a", 60, "N")], "k string, t int, v string")
    got = {r["t"]: r["matched_at"] for r in ev.match_transitions(truth, pred, ["k"], "t", "v").collect()}
    assert got == {10: 20, 50: 60}
    ep = spark.createDataFrame([("a", 0, 10, 20), ("a", 1, 40, 50)], "k string, e int, s int, z int")
    al = spark.createDataFrame([("a", 1, 12), ("a", 2, 15), ("a", 3, 30), ("a", 4, 38)], "k string, id int, at int")
    out = lambda tol: {r["id"]: r["outcome"] for r in ev.match_alerts(ep, al, ["k"], "e", ("s", "z"), "at", "id", tol).collect()}
    assert out(0) == {1: "hit", 2: "duplicate", 3: "false", 4: "false"}
    assert out(3)[4] == "hit"


def test_alerts_before_many_short_episodes(spark):
    """The earliest episode takes the alert, though others begin within the tolerance or lie inside it."""
    ep = spark.createDataFrame([("a", 0, 10, 20), ("a", 1, 21, 22), ("a", 2, 23, 24), ("a", 3, 25, 26), ("a", 4, 60, None), ("b", 0, 0, 100), ("b", 1, 10, 20), ("b", 2, 20, 20)], "k string, e int, s int, z int")
    al = spark.createDataFrame([("a", 1, 19), ("a", 2, 20), ("a", 3, 22), ("a", 4, 26), ("a", 5, 61), ("a", 6, 1), ("b", 7, 50), ("b", 8, 5), ("b", 9, 100)], "k string, id int, at int")
    for tol, want in ((8, {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: 0, 8: 0, 9: None}), (0, {1: 0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 0, 8: 0, 9: None})):
        assert {r["id"]: r["e"] for r in ev.match_alerts(ep, al, ["k"], "e", ("s", "z"), "at", "id", tol).collect()} == want


def test_scoring_texts(spark):
    cases = [
        ("boolean_match", "Yes: the segment tests positive", "yes", None, True),
        ("normalized_match", "A. low heart rate", "low", None, True),
        ("numeric_tolerance", "about 74 bpm", "72", 3.0, True),
        ("numeric_tolerance", "min 31 and max 122 in here; all in all the pulse rate is approximately 60", "62.3", 5.0, True),
        ("numeric_tolerance", "normal range is 60-100 and it is about 80", "82", 5.0, False),
        ("numeric_tolerance", "about 74 bpm", "72", 0.0, True),  # only a positive tolerance is absolute
        ("numeric_tolerance", "about 80 bpm", "72", None, False),
        ("numeric_tolerance", None, "72", 3.0, False),
    ]
    df = spark.createDataFrame(cases, "m string, p string, g string, t double, want boolean")
    got = df.select("want", tx.score(F.col("m"), F.col("p"), F.col("g"), F.col("t"), ["low", "normal", "high"]).alias("b"), tx.answer_numbers(F.col("p")).alias("n")).collect()
    assert [r["b"] for r in got] == [r["want"] for r in got]
    assert got[2]["n"] == [74.0] and got[3]["n"] == [60.0] and got[4]["n"] == [] and got[7]["n"] == []
    with pytest.raises(Exception, match="unknown evaluation method"):
        df.select(tx.score(F.lit("other"), F.col("p"), F.col("g"), F.col("t"), [])).collect()
    assert [tx.relative_tolerance(x) for x in (None, " ", "0.1", "-3", "x")] == [0.05, 0.05, 0.1, 0.0, 0.05]


def test_chosen_paths():
    assert rc.chosen_path("new", "old", {"old": True}) == "old" and rc.chosen_path("new", "old", {"old": True, "new": True}) == "new" == rc.chosen_path("new", "old", {})


def test_text_helpers(spark):
    w = tx.parse_window_id(F.lit("ppg:007:chunk002:w000003:s000000100-e000000200"))
    assert one(spark, w)["end"] == 200
    assert one(spark, tx.parse_window_id(F.lit("ppg:007:chunk002:w000003:s000000200-e000000200"))) is None
    assert one(spark, tx.first_json_object(F.lit('say {"a": 1} now'))) == '{"a": 1}'
    assert one(spark, tx.question_id(F.lit("s"), F.lit("t"), F.lit("x0.5"), F.lit(1))) == "s__t__x0p5__p1"


def test_windowing(spark):
    pts = spark.createDataFrame([("a", t) for t in (0, 5, 12, 29)], "k string, t long")
    got = {r["window_start"]: r["n"] for r in wn.sliding(pts, ["k"], "t", 20, 10, [F.count(F.lit(1)).alias("n")], 30).collect()}
    assert got == {0: 3, 10: 2}
    assert wn.grid(spark.createDataFrame([("a", 0, 10)], "k string, s long, e long"), "s", "e", 20, 5).count() == 0


def test_markers(spark):
    rows = spark.createDataFrame([("a", 0, 5, "(N"), ("a", 1, 20, "(AFIB"), ("a", 2, 30, ")"), ("a", 3, 40, "(")], "k string, position int, at int, note string").withColumn("total", F.lit(50))
    got = [(r["span_start"], r["span_end"], r["label"]) for r in an.marker_spans(rows, ["k"], "at", "note", "total").orderBy("span_start").collect()]
    assert got == [(5, 20, "N"), (20, 30, "AFIB")]
    assert one(spark, an.map_label(F.lit("(AFIB"))) == "AF"
    days = spark.createDataFrame([("a", 0, None, 80000), ("a", 1, 2, 100), ("a", 2, None, 50)], "k string, n int, day int, clock int")
    assert [r["full_day"] for r in an.repaired_days(days, ["k"], ["n"], "day", "clock").orderBy("n").collect()] == [1, 2, 3]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, s string")
    assert {r["s"]: r["count"] for r in sm.stratified(df, "s", 7, 42, "id").groupBy("s").count().collect()} == {"a": 4, "b": 3}
    assert sm.split(df, ["s"], 0.3, 1, "id").where("split = 'dev'").count() == 6
    assert sm.preload(df.limit(1), 1.0, 1, "id").where("preloaded").count() == 1


def test_signal_kernels():
    rate, t = 50.0, np.arange(0, 10, 1 / 50)
    x = np.sin(2 * np.pi * 1.2 * t) + 3
    assert abs(sg.dominant_frequency_array(x, rate)[0] - 1.2) < 0.11
    assert len(sg.without_dicrotic(sg.peaks_array(sg.band_pass_array(x, rate), rate), rate)) == 12
    assert len(sg.resample_array(x, 7)) == 7 and len(sg.peaks_array(np.zeros(0), rate)) == 0


def test_drift_flags_a_jump(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, (rng.normal(0, 1, 8) + (20 if i == 70 else 0)).tolist()) for i in range(80)]
    got = {r["item"]: r["z"] for r in dr.drift(spark.createDataFrame(rows, "key long, item long, embedding array<double>"), 50).collect()}
    assert got[10] is None and got[70] > 5 and abs(got[60]) < 5


def test_stream_memory_drops_late_rows():
    m = Memory()
    assert m.step(1, 100, 70.0, "N", 10.0) and m.step(2, 50, 70.0, "N", 10.0) is None and m.late == 1


def test_records(spark, tmp_path):
    (tmp_path / "up.csv").write_text("time_ms,sample\n0,1.0\n4,2.0\n8,3.5\n12,1\n,\n")
    got = records.read_upload(spark, str(tmp_path / "up.csv")).first()
    assert got["signal"] == [1.0, 2.0, 3.5, 1.0] and got["sample_rate"] == 250.0
    (tmp_path / "x.txt").write_text("Device,Watch\nUnit,µV\nSampling Rate,512 Hz\n1000\n2000\n")
    got = records.read_upload(spark, str(tmp_path / "x.txt")).first()
    assert got["signal"] == [1.0, 2.0] and got["sample_rate"] == 512.0 and got["metadata"]["device"] == "Watch"
    (tmp_path / "odd.csv").write_text("timestamp_ms,Voltage\n0,1\n4,2\n20,3\n")
    with pytest.raises(Exception, match="increase evenly"):
        records.read_upload(spark, str(tmp_path / "odd.csv")).collect()
    with pytest.raises(ValueError):
        records.read_upload(spark, "x.bin")
    (tmp_path / "q.jsonl").write_text('{"question_id": "a", "answer": ["yes"], "answer_set": []}\nnot json\n')
    with pytest.raises(ValueError):
        records.read_questions(spark, str(tmp_path / "q.jsonl"))
    (tmp_path / "g.md").write_text("# T\n\n## One\nbody\n\n## Two\nmore\n")
    assert [(r["title"], r["body"]) for r in records.read_guidelines(spark, str(tmp_path / "g.md")).orderBy("place").collect()] == [("One", "body"), ("Two", "more")]


def test_wfdb_source(spark, tmp_path):
    values = np.array([[1, -2], [3, 4], [5, 6], [-7, 8]], "<i2")
    (tmp_path / "r1.dat").write_bytes(values.tobytes())
    (tmp_path / "r1.hea").write_text("r1 2 250 4\nr1.dat 16 100(0)/mV 16 0 0 0 0 I\nr1.dat 16 200/mV 16 0 0 0 0 II\n")
    word = lambda code, step: struct.pack("<H", code << 10 | step)
    (tmp_path / "r1.atr").write_bytes(word(28, 1) + word(63, 2) + b"(N" + word(1, 1) + word(5, 1) + word(0, 0))
    spark.dataSource.register(wfdb.WfdbSource)
    got = spark.read.format("wfdb").option("root", str(tmp_path)).option("records", "r1").option("sampfrom", 1).option("sampto", 4).load().first()
    assert got["leads"] == ["I", "II"] and got["signals"][0] == [0.03, 0.05, -0.07] and got["signals"][1] == [0.02, 0.03, 0.04]
    assert [(b["sample"], b["symbol"]) for b in got["beats"]] == [(1, "N"), (2, "V")] and [(b["sample"], b["note"]) for b in got["notes"]] == [(0, "(N")]


def test_wfdb_format_212(tmp_path):
    raw = [100, -5, 2000, -2048]
    data = bytearray()
    for a, b in zip(raw[::2], raw[1::2], strict=True):
        a, b = a & 0xFFF, b & 0xFFF
        data += bytes([a & 0xFF, (a >> 8) | (b >> 8) << 4, b & 0xFF])
    (tmp_path / "x.dat").write_bytes(bytes(data))
    (tmp_path / "x.hea").write_text("x 1 250 4\nx.dat 212 1(0)/mV 12 0 0 0 0 I\n")
    header = wfdb.read_header(tmp_path / "x.hea")
    assert wfdb.read_signals(tmp_path, header, 0, 4)[0].tolist() == raw and wfdb.read_signals(tmp_path, header, 1, 3)[0].tolist() == raw[1:3]
