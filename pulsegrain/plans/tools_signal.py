"""Named queries over signals: window analyses, state builders, the stress classifier, rhythm context, diagnosis.

Wearable recordings are one row a channel (see operators.wearables), converted once from their subject
files; reference recordings are one row a patient (patient, rate, n_samples, qrs, labels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrain.functions import signal as sg
from pulsegrain.functions import vitals as vt
from pulsegrain.operators import builders as bd
from pulsegrain.operators import catalogues as ct
from pulsegrain.operators import intervals as iv
from pulsegrain.operators import learn
from pulsegrain.operators import monitoring as mo
from pulsegrain.operators import sequence as seq
from pulsegrain.operators import wearables as we
from pulsegrain.schema import canonical_dataset, with_effective_keys
from pulsegrain.sources.wfdb import WfdbSource

from .tools import Session, _rows, tool


def _merge(session: Session, fresh: DataFrame, clear: bool) -> dict:
    """Built states into the store: they replace states of the same id."""
    filled = with_effective_keys(fresh.withColumn("dataset", canonical_dataset(F.col("dataset"))))
    kept = session.states.limit(0) if clear else session.states.join(filled.select("state_id"), "state_id", "left_anti")
    session.states = kept.unionByName(filled)
    return {"states": filled.count()}


def _subject(session: Session, subject_id: str | None, patient_id: str | None, path: str | None) -> tuple[DataFrame, str]:
    """The channels of one subject, from a converted file or from those that are registered."""
    channels = session.spark.read.parquet(path) if path else session.wearables
    if channels is None:
        raise ValueError("no wearable recording is registered; convert the subject file first")
    wanted = subject_id or patient_id
    found = channels.where(F.col("subject") == wanted) if wanted else channels
    names = [r[0] for r in found.select("subject").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"the recording of {wanted or 'one subject'} is not known")
    return found, names[0]


def _window(start: float | None, end: float | None) -> tuple[float, float]:
    if start is None or end is None or end <= start:
        raise ValueError("window_end_s must be greater than window_start_s")
    return float(start), float(end)


def _stats(values: Column, seconds: float) -> Column:
    clean = vt.finite(values)
    return F.when(F.size(clean) > 0, F.struct(F.round(vt.mean(clean), 4).alias("mean"), F.round(vt.std(clean), 4).alias("std"), F.array_min(clean).alias("min"), F.array_max(clean).alias("max"), F.round((F.get(clean, F.size(clean) - 1) - F.get(clean, F.lit(0))) / seconds, 6).alias("slope_per_s")))


def _signal_context(channels: DataFrame, subject: str, start: float, end: float, chest: bool, activity_rate: float | None = None) -> dict:
    """Pulse, motion, skin and (if wanted) chest signals of one window."""
    names = [*we.RATES, *(["activity", "hr"] if activity_rate else [])]
    rates = {**we.RATES, "activity": activity_rate or 4.0, "hr": 0.5}
    spark = channels.sparkSession
    row = we.windowed(channels, spark.createDataFrame([(subject, start, end)], "subject string, start_s double, end_s double"), names, rates)
    col = lambda n: F.col(n.replace(".", "_"))
    bvp, acc = col("signal.wrist.BVP"), col("signal.wrist.ACC")
    rr = lambda c, rate: vt.plausible(F.transform(vt.differences(sg.pulse_peaks(c, F.lit(rate)).cast("array<double>")), lambda d: d * 1000.0 / rate), 250, 2000)
    pulse = rr(bvp, 64.0)
    quality = vt.saturated(vt.snr_proxy(bvp), 5.0)
    seconds = end - start
    wanted = [
        F.when(F.size(bvp) > 0, F.struct(F.round(vt.heart_rate(pulse), 1).alias("mean_bpm"), F.round(vt.peak_instant_rate(pulse), 1).alias("max_bpm"), vt.quality_label(quality).alias("quality"), F.size(pulse).alias("intervals"))).alias("bvp_pulse"),
        F.when(F.size(acc) > 0, vt.motion_level(*(F.transform(we.axis(acc, k), lambda v: v / 64.0) for k in range(3)))).alias("motion_level"),
        *(_stats(col(f"signal.{n}"), seconds).alias(a) for n, a in (("wrist.EDA", "eda"), ("wrist.TEMP", "temperature"), ("chest.Resp", "respiration"))),
        F.when(F.lit(chest) & (F.size(col("signal.chest.ECG")) > 0), F.struct(F.round(vt.heart_rate(rr(col("signal.chest.ECG"), 700.0)), 1).alias("mean_bpm"))).alias("chest_ecg"),
    ]
    if activity_rate:
        wanted.append(_stats(F.col("hr"), seconds).alias("ecg_reference_hr"))
    return {"window": {"start_s": start, "end_s": end, "duration_s": seconds}, **_rows(row.select(*wanted))[0]}


def _dominant(channels: DataFrame, channel: str, rate: float, start: float, end: float, names: dict[int, str], least: float) -> dict | None:
    marks = we.labels(channels, channel).where((F.col("sample") >= round(start * rate)) & (F.col("sample") < round(end * rate))).withColumn("one", F.lit(1))
    found = _rows(iv.mode_smallest(marks, ["one"], "label"))
    if not found:
        return None
    name = names.get(found[0]["mode"])
    return {"label_id": found[0]["mode"], "label": name, "fraction": found[0]["fraction"], "clean": name is not None and found[0]["fraction"] >= least}


@tool
def analyze_wesad_window_signal(session: Session, subject_id=None, patient_id=None, pickle_path=None, dataset_root=None, dataset=None, window_start_s=None, window_end_s=None, include_chest_ecg_analysis=False, min_label_fraction=0.8) -> dict:
    """A window's signals and protocol label; pickle_path names the converted file."""
    start, end = _window(window_start_s, window_end_s)
    channels, subject = _subject(session, subject_id, patient_id, pickle_path)
    return {"subject_id": subject, **_signal_context(channels, subject, start, end, include_chest_ecg_analysis), "protocol_label": _dominant(channels, "label", 700.0, start, end, we.PROTOCOL, min_label_fraction)}


@tool
def analyze_ppg_dalia_window_signal(session: Session, subject_id=None, patient_id=None, pickle_path=None, dataset_root=None, dataset=None, window_start_s=None, window_end_s=None, include_chest_ecg_analysis=False) -> dict:
    """A window's signals, activity and reference rate; the rate channel is `hr`, at 0.5 Hz."""
    start, end = _window(window_start_s, window_end_s)
    channels, subject = _subject(session, subject_id, patient_id, pickle_path)
    return {"subject_id": subject, **_signal_context(channels, subject, start, end, include_chest_ecg_analysis, 4.0), "activity": _dominant(channels, "activity", 4.0, start, end, we.ACTIVITIES, 0.8)}


@tool
def analyze_icentia11k_ecg_window_signal(session: Session, patient_id: str, window_start_s: float, window_end_s: float, dataset=None, recording_id=None, segment_id=None, local_root=None) -> dict:
    """A window of a segment: rates by annotated beats, and what the signal itself tells."""
    start, end = _window(window_start_s, window_end_s)
    record = f"{patient_id}_{segment_id or recording_id}"
    session.spark.dataSource.register(WfdbSource)
    source = session.spark.read.format("wfdb").option("root", local_root or session.wfdb_root).option("records", record)
    head = source.option("headeronly", True).load().first()
    rate, total = head["fs"], head["n_samples"]
    low, high = round(start * rate), min(round(end * rate), total)
    if low >= high:
        raise ValueError(f"the window begins beyond the segment's {total / rate:g} s")
    read = lambda a, b: session.spark.read.format("wfdb").option("root", local_root or session.wfdb_root).option("records", record).option("sampfrom", a).option("sampto", b).load()
    signal, seconds = F.get("signals", F.lit(0)), (high - low) / rate
    peaks = sg.pulse_peaks(signal, F.col("fs"))
    rows = read(low, high).withColumn("peaks", peaks)
    rr = vt.plausible(F.transform(vt.differences(F.col("peaks").cast("array<double>")), lambda d: d * 1000.0 / rate), 300, 2000)
    found = _rows(rows.select(vt.usability(signal, F.size("peaks")).alias("signal_quality"), F.round(vt.heart_rate(rr), 1).alias("mean_bpm"), vt.classify_rhythm(rr).alias("rhythm"), F.round(vt.variation(rr), 6).alias("coefficient_of_variation"), F.when(F.col("beats").isNotNull(), F.size("beats")).alias("beats")))[0]

    def half_minutes(a: int, b: int) -> dict:
        width = round(30 * rate)
        beats = read(a, b).select(F.explode("beats").alias("b")).groupBy(F.floor(F.col("b.sample") / width).alias("w")).agg(F.count(F.lit(1)).alias("n")).where((F.col("w") + 1) * width <= b - a)
        return _rows(beats.agg(F.max(F.col("n") * 2.0).alias("max_30s_bpm"), F.min(F.col("n") * 2.0).alias("min_30s_bpm")))[0]

    annotated = {}
    if found.get("beats"):
        context = half_minutes(0, min(total, max(high, round(1800 * rate))))
        annotated = {"mean_bpm": round(found["beats"] / seconds * 60, 1), **half_minutes(low, high), **({"monitoring_context_max_30s_bpm": context["max_30s_bpm"]} if context else {})}
    signal_side = {k: found.get(k) for k in ("mean_bpm", "rhythm", "coefficient_of_variation", "signal_quality")}
    return {"heart_rate": annotated or {"mean_bpm": found.get("mean_bpm")}, "signal": signal_side, "sample_start": low, "sample_end": high, "sampling_rate": rate}


@tool
def state_build_from_wesad_pickle(session: Session, pickle_path: str, clear_existing=False, window_secs=None, max_windows=None) -> dict:
    """States of clean protocol windows of a converted subject."""
    channels, _ = _subject(session, None, None, pickle_path)
    width = round((window_secs or 60) * 700)
    built = bd.label_states(we.labels(channels), "wesad", 700.0, width, we.PROTOCOL)
    return _merge(session, built if max_windows is None else built.orderBy("window_index").limit(max_windows), clear_existing)


@tool
def state_build_from_ppg_dalia_pickle(session: Session, pickle_path: str, clear_existing=False, window_secs=None, max_windows=None, window_stride_sec=None, activity_label_fs_hz=None, min_activity_fraction=0.8, include_transition_windows=False) -> dict:
    """States of windows with one activity, with the mean and highest reference rate of the window."""
    channels, _ = _subject(session, None, None, pickle_path)
    rate, seconds = activity_label_fs_hz or 4.0, window_secs or 30
    if rate <= 0 or seconds <= 0 or not 0 < min_activity_fraction <= 1:
        raise ValueError("rate and width must be positive, the fraction in (0, 1]")
    names = {**we.ACTIVITIES, **({0: "transition"} if include_transition_windows else {})}
    marks = we.labels(channels, "activity")
    # two seconds a reference value: at the activity's positions
    hr = channels.where(F.col("channel") == "hr").select(F.col("subject").alias("subject_id"), F.col("subject").alias("recording_id"), F.posexplode("samples").alias("k", "bpm")).select("subject_id", "recording_id", (F.col("k") * 2 * rate).cast("long").alias("sample"), "bpm")
    built = bd.label_states(marks, "ppg_dalia", rate, round(seconds * rate), names, min_activity_fraction, hr)
    states = built.withColumns({"activity_label": F.col("stress_label"), "previous_activity_label": F.col("previous_stress_label")}).withColumns({c: F.lit(None).cast("string") for c in ("stress_label", "previous_stress_label", "dominant_stress_label")} | {c: F.lit(None).cast("double") for c in ("stress_burden_ratio", "stress_duration_s")} | {c: F.lit(None).cast("int") for c in ("protocol_label_id", "previous_protocol_label_id")})
    return _merge(session, states if max_windows is None else states.orderBy("window_index").limit(max_windows), clear_existing)


def _reference(session: Session, patient_id: str) -> tuple[DataFrame, float, int]:
    if session.references is None:
        raise ValueError("no reference recordings are registered")
    found = session.references.where(F.col("patient") == patient_id)
    head = found.select("rate", "n_samples", F.size("qrs").alias("beats")).first()
    if head is None or head["rate"] <= 0 or not head["beats"]:
        raise ValueError(f"no reference beats of {patient_id}")
    return found, head["rate"], head["n_samples"]


def _beats(reference: DataFrame) -> DataFrame:
    pairs = reference.select(F.col("patient").alias("subject_id"), F.lit("ecg").alias("recording_id"), F.posexplode(F.arrays_zip(F.col("qrs").alias("sample"), F.col("labels").alias("label"))).alias("place", "b"))
    return pairs.select("subject_id", "recording_id", "place", F.col("b.sample").alias("sample"), F.col("b.label").alias("label")).where("sample IS NOT NULL AND label IS NOT NULL")


@tool
def state_build_from_ppg_patient(session: Session, patient_id: str, dataset_root=None, clear_existing=False, window_sec=300, max_windows=None, rhythm_threshold=0.5, ambiguous_rhythm_margin=None, min_annotation_coverage_ratio=0.8) -> dict:
    """States of windows over a reference recording; windows with too little annotation are left out."""
    reference, rate, total = _reference(session, patient_id)
    beats = _beats(reference)
    width = round(window_sec * rate)
    spans = seq.rhythm_segments(beats, bd.KEYS, ["sample", "place"], "sample", "label").select(*bd.KEYS, F.col("seg_start").alias("span_start"), F.col("seg_end").alias("span_end"), F.when(F.col("label") == 1, "AF").otherwise("N").alias("label")).where("span_end > span_start")
    recordings = session.spark.createDataFrame([(patient_id, "ecg", 0, total)], "subject_id string, recording_id string, start long, end long")
    states = bd.rhythm_states(recordings, beats.select(*bd.KEYS, "sample"), spans, F.lit(float(rate)), "afppgecg", width, round(30 * rate))
    covered = iv.overlap_join(bd._windows(recordings, width, width), spans, bd.KEYS, ("window_start", "window_end"), ("span_start", "span_end"), width)
    share = iv.burden(covered, [*bd.KEYS, "window_index"], "label", "AF", F.lit(width)).where(F.col("coverage") >= min_annotation_coverage_ratio)
    rhythm = share.select(*bd.KEYS, "window_index", iv.burden_rhythm(F.col("annotated_burden"), rhythm_threshold, ambiguous_rhythm_margin or 0.0).alias("_rhythm"))
    kept = states.join(rhythm, [*bd.KEYS, "window_index"]).withColumn("rhythm_class", F.col("_rhythm")).select(*states.columns)
    return _merge(session, kept if max_windows is None else kept.orderBy("window_index").limit(max_windows), clear_existing)


@tool
def analyze_afppgecg_rhythm_context(session: Session, patient_id: str, anchor_window_start_s=None, anchor_window_end_s=None, scope="sampled_recording", n_sampled_chunks=60, dataset=None, window_start_s=None, window_end_s=None) -> dict:
    """Beats of a locator window and their rhythm; over the recording, the rhythm of sampled half minutes."""
    if scope not in ("locator_window", "sampled_recording"):
        raise ValueError("scope must be 'locator_window' or 'sampled_recording'")
    start, end = _window(anchor_window_start_s if anchor_window_start_s is not None else window_start_s, anchor_window_end_s if anchor_window_end_s is not None else window_end_s)
    reference, rate, total = _reference(session, patient_id)
    ordered = reference.select(F.array_sort("qrs").alias("q"))
    inside = lambda a, b: F.filter("q", lambda s: (s >= a * rate) & (s < b * rate))
    rr_of = lambda q: F.filter(F.transform(vt.differences(q.cast("array<double>")), lambda d: d * 1000.0 / rate), lambda d: d > 0)
    label_of = lambda q, least: F.when((F.size(q) >= least) & (F.size(rr_of(q)) >= 4), vt.classify_rhythm(rr_of(q))).otherwise("Unknown")
    anchor = inside(start, end)
    rr = rr_of(anchor)
    metrics = F.struct(F.size(rr).alias("rr_interval_count"), F.round(vt.mean(rr), 3).alias("mean_rr_ms"), F.round(vt.variation(rr), 6).alias("coefficient_of_variation"), F.round(F.sqrt(vt.mean(F.transform(vt.differences(rr), lambda d: d * d))), 3).alias("rmssd_ms"), F.round(vt.pnn50(rr), 3).alias("pnn50_percent"))
    out = {"anchor_window_summary": _rows(ordered.select(F.size(anchor).alias("n_qrs_beats"), label_of(anchor, 0).alias("rhythm_label"), metrics.alias("irregularity_metrics")))[0]}
    if scope == "locator_window":
        return out
    seconds = total / rate
    centres = ct.sample_centres(F.lit(float(seconds)), n_sampled_chunks) if seconds > 30 else F.array(F.lit(seconds / 2.0))
    chunks = ordered.select("q", F.posexplode(centres).alias("place", "c")).select("place", label_of(F.filter("q", lambda s: (s >= (F.col("c") - 15.0) * rate) & (s < (F.col("c") + 15.0) * rate)), 5).alias("label")).withColumn("k", F.lit(1))
    known = chunks.where("label <> 'Unknown'")
    counts = known.agg(F.count(F.lit(1)).alias("valid_chunk_count"), F.count_if(F.col("label") == "AF").alias("af_chunk_count"))
    found = _rows(counts)[0]
    runs = {r["label"]: r["longest"] for r in _rows(seq.longest_runs(chunks, ["k"], ["place"], "label"))}
    changes = _rows(seq.transition_counts(known, ["k"], ["place"], "label"))
    n = changes[0]["transitions"] if changes else 0
    per_hour = n / (seconds / 3600)
    label = "stable" if n <= 0 else "occasional_changes" if per_hour <= 3 else "frequent_changes"
    whole = rr_of(F.col("q"))
    spread = _rows(ordered.select(F.round(sg.sample_entropy(whole), 6).alias("rr_sample_entropy"), F.round(vt.poincare(whole)["ratio"], 6).alias("rr_poincare_sd1_sd2_ratio")))[0]
    af = found["af_chunk_count"] / found["valid_chunk_count"] if found["valid_chunk_count"] else 0.0
    out["extended_context_summary"] = {**found, "n_sampled_chunks": chunks.count(), "af_chunk_fraction": af, "max_consecutive_af_chunks": runs.get("AF", 0), "sustained_af_evidence": runs.get("AF", 0) >= 3, "transition_count": n, "transition_per_hour": per_hour, "variability_label": label, **spread}
    return out


@tool
def classify_wesad_stress_state(session: Session, subject_id=None, patient_id=None, pickle_path=None, dataset_root=None, dataset=None, window_start_s=None, window_end_s=None, model_path=None, train_subject_ids=None, exclude_subject_ids=None, exclude_release_eval_subjects=True, evaluate_subject_wise=False) -> dict:
    """The stress state of a window by a forest that has not seen its subject; trained here unless a saved model is named."""
    start, end = _window(window_start_s, window_end_s)
    channels, subject = _subject(session, subject_id, patient_id, pickle_path)
    metadata: dict = {}
    if model_path:
        model, metadata = learn.load(session.spark, model_path)
        if subject in metadata.get("train_subjects", []):
            raise ValueError("the model was trained on this subject")
    else:
        left_out = {subject, *(exclude_subject_ids or []), *(session.held_out_subjects if exclude_release_eval_subjects else [])}
        pool = session.wearables.where(~F.col("subject").isin(sorted(left_out)))
        if train_subject_ids:
            if left_out & set(train_subject_ids):
                raise ValueError("a held-out subject is among the training subjects")
            pool = pool.where(F.col("subject").isin(list(train_subject_ids)))
        rows = stress_training_rows(pool)
        model = learn.train(rows, we.FEATURES, "y")
        metadata = {"train_subjects": sorted(r[0] for r in rows.select("subject").distinct().collect()), "classes": _classes(rows)}
        if evaluate_subject_wise:
            metadata["subject_accuracy"] = {r["subject"]: r["accuracy"] for r in learn.leave_one_out(rows, we.FEATURES, "y", "subject").collect()}
    window = session.spark.createDataFrame([(subject, start, end)], "subject string, start_s double, end_s double")
    scored = learn.probabilities(model.transform(we.features(channels, window).withColumn("weight", F.lit(1.0))), metadata["classes"])
    row = _rows(scored.select("prediction", *(f"p_{c}" for c in metadata["classes"])))[0]
    return {"subject_id": subject, "stress_state": metadata["classes"][int(row["prediction"])], "probabilities": {c: row[f"p_{c}"] for c in metadata["classes"]}, **metadata}


def stress_training_rows(channels: DataFrame, width_s: float = 60, stride_s: float = 30, cap: int = 80, share: float = 0.9) -> DataFrame:
    """Features of clean windows with their class number (names in alphabetical order)."""
    grid = we.clean_grid(channels, width_s, stride_s, list(we.PROTOCOL), share, cap)
    names = F.create_map(*(F.lit(x) for kv in we.PROTOCOL.items() for x in kv))[F.col("label")]
    rows = we.features(channels, grid).withColumn("name", names)
    known = sorted(r[0] for r in grid.select(names.alias("n")).distinct().collect())
    return rows.withColumn("y", (F.array_position(F.array(*(F.lit(n) for n in known)), F.col("name")) - 1).cast("double"))


def _classes(rows: DataFrame) -> list[str]:
    return [r["name"] for r in rows.select("y", "name").distinct().orderBy("y").collect()]


@tool
def ecg_diagnosis(session: Session, record_id: str, sampling_rate=500, mode="12_lead", top_k_predictions=10, top_k_findings=15, min_probability=0.1) -> dict:
    """Ranked findings of the diagnosis network that the session is given: a function of a record's rows to (label, probability)."""
    if mode not in ("12_lead", "single_lead"):
        raise ValueError("mode must be '12_lead' or 'single_lead'")
    if session.diagnose is None:
        raise ValueError("no diagnosis model is registered")
    recorded = session.recordings.where((F.col("record_id") == record_id) | (F.col("metadata")["of"] == record_id))
    predictions = session.diagnose(recorded, mode).withColumn("record_id", F.lit(record_id))
    findings = ct.ranked_findings(predictions, ["record_id"], "probability", min_probability, min(top_k_predictions, top_k_findings), F.lit(False), "label")
    return {"mode": mode, "findings": _rows(findings.orderBy("rank").select("rank", "label", "probability"))}


@tool
def eval_state_build_missing_context(session: Session, dataset: str, subject_id: str, recording_id: str | None = None) -> dict:
    """Builds the states of a context that is not loaded, by the first fitting entry of the session's manifest; label fields stay hidden if asked."""
    loaded = session.matching(dataset=dataset, subject_id=subject_id, recording_id=recording_id, qualified=False)
    n = loaded.count()
    if n:
        return {"cached": True, "states": n}
    entry = next((e for e in session.manifest if e["dataset"] == dataset and e.get("subject_id") in (None, subject_id) and e.get("recording_id") in (None, recording_id)), None)
    if entry is None:
        raise ValueError(f"the manifest has no source for {dataset} {subject_id}")
    answer = session.call(entry["tool"], **entry["arguments"])
    if not answer["success"]:
        raise ValueError(answer["error"])
    if session.hide_labels:
        from pulsegrain.functions.records import LABEL_FIELDS

        own = (F.col("dataset") == dataset) & (F.col("eff_subject") == subject_id)
        session.states = session.states.withColumns({c: F.when(~own, F.col(c)) for c in LABEL_FIELDS if c in session.states.columns})
    return {"cached": False, "states": answer["data"]["states"], "annotation_bounds": _rows(mo.annotation_bounds(session.matching(dataset=dataset, subject_id=subject_id, qualified=False), ["dataset"], "eff_start", "eff_end"))}
