"""Named queries with one call envelope: what a client of the engine calls.

    session = Session(spark)
    session.call("state_load_monitoring_states", state_path="states.jsonl")
    session.call("state_get_current_monitoring_state", dataset="icentia11k", timestamp_s=35.0)

Every call returns {"success": True, "data": ...} or {"success": False, "error": ...}.  Tables stay
DataFrames; a call collects the few rows of its answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.functions import morphology as mo
from pulsegrain.functions import signal as sg
from pulsegrain.functions import text as tx
from pulsegrain.functions import vitals as vt
from pulsegrain.functions.records import LABEL_FIELDS
from pulsegrain.operators import catalogues as ct
from pulsegrain.operators import rules as rl
from pulsegrain.operators import sequence as seq
from pulsegrain.operators import state as st
from pulsegrain.operators import tracker as tr
from pulsegrain.runtime import ship
from pulsegrain.schema import STATE, canonical_dataset, with_effective_keys
from pulsegrain.sources import records

KEYS = ["dataset", "eff_subject", "eff_recording"]
ORDER = ["eff_start", "window_index"]
IDENTITY = ["state_id", "dataset", "eff_subject", "eff_recording", "eff_start", "eff_end"]
#: Default fields of an answer and what each trend needs.
FIELDS = ["hr_bpm", "rhythm_class", "stress_label", "activity_label", "af_burden_ratio", "stress_burden_ratio", "max_hr_bpm"]
TRENDS = {
    "hr_summary": ["hr_bpm"],
    "af_burden": ["af_burden_ratio"],
    "rhythm_transition_count": ["rhythm_class"],
    "stress_burden": ["stress_label"],
    "stress_duration": ["stress_label"],
    "stress_transition_count": ["stress_label"],
    "activity_distribution": ["activity_label"],
}
#: Which calls look at the signals of a data set, the window analysis first.
ANALYSES = {
    "icentia11k": ("analyze_icentia11k_ecg_window_signal", "evaluate_proactive_rules"),
    "ppg_dalia": ("analyze_ppg_dalia_window_signal",),
    "wesad": ("analyze_wesad_window_signal", "classify_wesad_stress_state"),
    "afppgecg": ("analyze_afppgecg_rhythm_context", "analyze_pulse_rate", "analyze_prv", "assess_ppg_signal_quality", "analyze_ppg_rhythm_irregularity"),
}
_REGISTRY: dict[str, Callable] = {}


def tool(function: Callable) -> Callable:
    _REGISTRY[function.__name__] = function
    return function


def names() -> list[str]:
    return sorted(_REGISTRY)


def _rows(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


class Session:
    """The loaded tables of one client."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship(spark)
        self.states = with_effective_keys(spark.createDataFrame([], STATE))
        self.contexts: DataFrame | None = None
        self.recordings: DataFrame | None = None
        self.wearables: DataFrame | None = None
        self.references: DataFrame | None = None
        self.wfdb_root = "."
        self.diagnose: Callable[[DataFrame, str], DataFrame] | None = None
        self.held_out_subjects: list[str] = []
        self.manifest: list[dict] = []
        self.hide_labels = False
        self.disabled: set[str] = set()

    def call(self, name: str, **arguments) -> dict:
        if name not in _REGISTRY or name in self.disabled:
            return {"success": False, "error": f"unknown or disabled tool: {name}"}
        try:
            return {"success": True, "data": _REGISTRY[name](self, **arguments)}
        except Exception as e:  # noqa: BLE001  the envelope is the contract
            return {"success": False, "error": f"{type(e).__name__}: {e}"}

    def clear(self) -> None:
        """Forgets all states."""
        self.states = self.states.limit(0)

    def keep_only(self, state_ids: DataFrame) -> None:
        """Keeps the states that a table of state_id names."""
        self.states = self.states.join(state_ids.select("state_id").distinct(), "state_id", "left_semi")

    def hide_label_fields(self) -> None:
        """Empties what comes from labels in all loaded states."""
        self.states = self.states.withColumns({c: F.lit(None).cast(self.states.schema[c].dataType) for c in LABEL_FIELDS if c in self.states.columns})

    def restrict(self, dataset: str, modes: tuple[str, ...] = ("state", "signal")) -> list[str]:
        """Leaves the calls that a data set's questions may use: the store's, and the analyses of its own signals."""
        allowed = {n for n in _REGISTRY if n.startswith("state_get_") or n == "state_list_contexts"} if "state" in modes else set()
        allowed |= set(ANALYSES.get(dataset, ())) if "signal" in modes else set()
        self.disabled = set(_REGISTRY) - allowed
        return sorted(allowed)

    def analyse(self, dataset: str, **arguments) -> dict:
        """The window analysis of a data set's signals."""
        if dataset not in ANALYSES:
            return {"success": False, "error": f"no window analysis for {dataset}"}
        return self.call(ANALYSES[dataset][0], **arguments)

    def matching(self, dataset=None, subject_id=None, patient_id=None, recording_id=None, qualified: bool = True) -> DataFrame:
        """States of the named context; an unqualified call must fit one context."""
        found = self.states
        if dataset is not None:
            found = found.where(F.col("dataset") == canonical_dataset(F.lit(dataset)))
        found = st.matching(found, eff_subject=subject_id or patient_id, eff_recording=recording_id)
        if qualified:
            st.require_unambiguous(found, KEYS)
        return found


@tool
def state_load_monitoring_states(session: Session, state_path: str, clear_existing: bool = False) -> dict:
    read = records.read_states(session.spark, state_path)
    fresh = with_effective_keys(read.withColumn("dataset", canonical_dataset(F.col("dataset"))))
    both = fresh if clear_existing else session.states.withColumn("_turn", F.lit(0)).unionByName(fresh.withColumn("_turn", F.lit(1)))
    order = [F.coalesce(F.col(c), F.lit(0)) for c in ORDER]
    session.states = st.last_write(both, "state_id", order if clear_existing else [F.col("_turn"), *order]).drop("_turn")
    return {"states": session.states.count()}


@tool
def state_list_contexts(session: Session) -> list[dict]:
    return _rows(st.contexts(session.states, KEYS, "eff_start", "modality", "eff_start", "eff_end").orderBy(*KEYS))


@tool
def state_get_current_monitoring_state(session: Session, timestamp_s: float | None = None, fields: list[str] | None = None, **context) -> dict | None:
    """The state that contains the time, else the latest before it; the last one without a time."""
    found = session.matching(**context)
    if timestamp_s is not None:
        probe = found.select(*KEYS).distinct().withColumn("at", F.lit(float(timestamp_s)))
        picked = st.current_as_of(found, probe, KEYS, "eff_start", "eff_end", "state_id", "at").select(F.col("picked").alias("state_id"))
        found = found.join(picked, "state_id", "left_semi")
    rows = _rows(found.orderBy(F.desc("eff_start"), F.desc("window_index")).limit(1).select(*IDENTITY, *(fields or FIELDS)))
    return rows[0] if rows else None


@tool
def state_get_monitoring_window(session: Session, start_s: float, end_s: float, fields: list[str] | None = None, limit: int = 200, **context) -> dict:
    found = st.overlapping(session.matching(**context), start_s, end_s, "eff_start", "eff_end")
    rows = _rows(st.with_total(found, ORDER, limit).select(*IDENTITY, *(fields or FIELDS), "total_count"))
    return {"total_count": rows[0]["total_count"] if rows else 0, "states": [{k: v for k, v in r.items() if k != "total_count"} for r in rows]}


@tool
def state_get_previous_monitoring_state(session: Session, state_id: str, offset: int = 1, fields: list[str] | None = None) -> dict | None:
    marked = st.previous(session.states, KEYS, ORDER, ["state_id"], offset).where(F.col("state_id") == state_id).select(F.col("previous_state_id").alias("state_id"))
    rows = _rows(session.states.join(marked, "state_id", "left_semi").select(*IDENTITY, *(fields or FIELDS)))
    return rows[0] if rows else None


@tool
def state_get_longitudinal_trend(session: Session, target: str, start_s: float | None = None, end_s: float | None = None, **context) -> dict:
    if target not in TRENDS:
        raise ValueError(f"unknown trend target: {target}; known: {sorted(TRENDS)}")
    found = session.matching(**context)
    if start_s is not None and end_s is not None:
        found = st.overlapping(found, start_s, end_s, "eff_start", "eff_end")
    if found.where(" AND ".join(f"{c} IS NOT NULL" for c in TRENDS[target])).limit(1).count() == 0:
        raise ValueError(f"no state supports {target}")
    hr, col = F.coalesce("hr_bpm", "mean_hr_bpm"), F.col
    answers: dict[str, Callable[[], DataFrame]] = {
        "hr_summary": lambda: st.hr_summary(found, KEYS, hr, F.coalesce(col("max_hr_bpm"), hr)),
        "af_burden": lambda: st.burden_summary(found, KEYS, col("af_burden_ratio"), col("rhythm_class"), "AF", "eff_start"),
        "rhythm_transition_count": lambda: seq.transition_counts(found, KEYS, ORDER, "rhythm_class"),
        "stress_burden": lambda: st.burden_summary(found, KEYS, col("stress_burden_ratio"), col("stress_label"), "stress", "eff_start"),
        "stress_duration": lambda: st.labelled_duration(found, KEYS, col("stress_label"), "stress", col("eff_duration")),
        "stress_transition_count": lambda: seq.transition_counts(found, KEYS, ORDER, "stress_label"),
        "activity_distribution": lambda: st.distribution(found, KEYS, "activity_label"),
    }
    return {"target": target, "rows": _rows(answers[target]())}


@tool
def state_get_evidence(session: Session, state_id: str, target: str) -> dict | None:
    rows = _rows(session.states.where(F.col("state_id") == state_id).select(*IDENTITY, *TRENDS.get(target, FIELDS)))
    return rows[0] if rows else None


@tool
def state_get_dataset_capabilities(session: Session, dataset: str) -> dict:
    """Targets that some state of the data set supports; an unknown one has none."""
    rows = _rows(st.capabilities(session.matching(dataset=dataset, qualified=False), ["dataset"], TRENDS))
    found = {k: v for k, v in (rows[0] if rows else {}).items() if k in TRENDS}
    return {"dataset": dataset, "capabilities": found, "unsupported": sorted(k for k, v in found.items() if not v)}


@tool
def proactive_load_patient_context(session: Session, context_path: str, clear_existing: bool = False) -> dict:
    fresh = records.read_contexts(session.spark, context_path)
    session.contexts = fresh if clear_existing or session.contexts is None else session.contexts.unionByName(fresh, allowMissingColumns=True)
    return {"contexts": session.contexts.count()}


@tool
def proactive_list_patient_contexts(session: Session) -> list[str]:
    return [] if session.contexts is None else sorted(r[0] for r in session.contexts.select("patient_id").distinct().collect())


def _alerts(session: Session, patient_id: str | None) -> DataFrame:
    if session.contexts is None:
        raise ValueError("no patient context is loaded")
    found = st.matching(session.contexts, patient_id=patient_id)
    st.require_unambiguous(found, ["patient_id"])
    return found.select("patient_id", F.explode("alerts").alias("a")).select("patient_id", "a.*")


@tool
def proactive_get_recent_alerts(session: Session, patient_id: str | None = None, limit: int = 5, include_false_alerts: bool = True) -> list[dict]:
    found = _alerts(session, patient_id)
    kept = found if include_false_alerts else found.where(~F.coalesce("is_false_alert", F.lit(False)))
    return _rows(kept.orderBy(F.desc("alert_id")).limit(limit))


@tool
def proactive_explain_last_alert(session: Session, patient_id: str | None = None) -> dict | None:
    rows = _rows(_alerts(session, patient_id).orderBy(F.desc("alert_id")).limit(1))
    if not rows:
        return None
    last = rows[0]
    return {**last, "explanation": f"{last.get('urgency', 'none')} alert: {', '.join(last.get('triggered_rules', []))}. {last.get('reason', '')}".strip()}


@tool
def evaluate_proactive_rules(session: Session, include_phase2_rules: bool = False, **context) -> dict:
    """Replays the rules over a context's states and sums up rhythm."""
    modality = "ecg"
    found = session.matching(**context).withColumn("_us", (F.col("eff_duration") * 1_000_000).cast("long"))
    judged = rl.evaluate(tr.track(found, KEYS, ORDER, duration="_us"), rl.rules_for(modality, include_phase2_rules))
    summary = tr.rhythm_summary(found, KEYS, ORDER, "rhythm_class")
    return {"first_triggers": _rows(rl.first_triggers(judged, KEYS, "eff_start")), "alerts": rl.alerts(judged, KEYS, ORDER).count(), "rhythm": _rows(summary)}


# --- recordings: (record_id, source, sampling_rate, signal, metadata) ---------------------------


def _record(session: Session, record_id: str) -> DataFrame:
    if session.recordings is None:
        raise ValueError("no recordings are registered")
    found = session.recordings.where(F.col("record_id") == record_id)
    if not found.take(1):
        raise ValueError(f"unknown record: {record_id}")
    return found


def _with_intervals(session: Session, record_id: str) -> DataFrame:
    peaks = sg.pulse_peaks(F.col("signal"), F.col("sampling_rate"))
    beats = _record(session, record_id).withColumn("beats", peaks)
    return beats.withColumn("rr", vt.plausible(F.transform(vt.differences(F.col("beats").cast("array<double>")), lambda d: d * 1000.0 / F.col("sampling_rate")), 250, 2000))


@tool
def list_ecg_records(session: Session, limit: int = 20, age_min: float | None = None, age_max: float | None = None, diagnostic_class: str | None = None) -> list[dict]:
    """Uploaded records first, then clinical ones; an unknown age fails a bound, classes are those of the metadata."""
    if session.recordings is None:
        return []
    m = F.col("metadata")
    found = ct.search(session.recordings.withColumns({"age": m["age"].try_cast("double"), "sex": m["sex"]}), "age", "sex", age_min, age_max, None)
    if diagnostic_class is not None:
        found = found.where(F.array_contains(F.split(F.coalesce(m["classes"], F.lit("")), ","), diagnostic_class))
    order = F.when(F.col("source") == "uploaded", 0).otherwise(1)
    return _rows(found.orderBy(order, "source", "record_id").limit(limit).select("record_id", "source", "sampling_rate", F.size("signal").alias("samples"), "age"))


@tool
def get_ecg_metadata(session: Session, record_id: str) -> dict:
    return _rows(_record(session, record_id).select("record_id", "source", "sampling_rate", "metadata", (F.size("signal") / F.col("sampling_rate")).alias("duration_s")))[0]


@tool
def get_ecg_description(session: Session, record_id: str) -> str:
    m = get_ecg_metadata(session, record_id)
    return f"{m['record_id']}: {m['duration_s']:.1f} s at {m['sampling_rate']:g} Hz from {m['source']}"


@tool
def analyze_heart_rate(session: Session, record_id: str) -> dict:
    rr = F.col("rr")
    return _rows(_with_intervals(session, record_id).select(F.round(vt.heart_rate(rr), 1).alias("mean_hr"), F.round(vt.peak_instant_rate(rr), 1).alias("max_hr"), vt.hr_assessment(vt.heart_rate(rr)).alias("assessment"), vt.rr_category(vt.mean(rr)).alias("rr_assessment")))[0]


@tool
def analyze_hrv(session: Session, record_id: str) -> dict:
    rr = F.col("rr")
    return _rows(_with_intervals(session, record_id).select(vt.sdnn(rr).alias("sdnn_ms"), vt.rmssd(rr).alias("rmssd_ms"), vt.pnn50(rr).alias("pnn50"), vt.variation(rr, 1).alias("cv"), vt.poincare(rr).alias("poincare"), sg.sample_entropy(rr).alias("sample_entropy")))[0]


@tool
def analyze_pulse_rate(session: Session, record_id: str) -> dict:
    return analyze_heart_rate(session, record_id)


@tool
def analyze_prv(session: Session, record_id: str) -> dict:
    return analyze_hrv(session, record_id)


@tool
def analyze_ppg_rhythm_irregularity(session: Session, record_id: str, quality: float = 1.0) -> dict:
    rr = F.col("rr")
    votes = vt.pulse_irregular(vt.variation(rr), vt.pnn50(rr), vt.rmssd(rr), F.lit(quality))
    return _rows(_with_intervals(session, record_id).select(votes.alias("irregular"), vt.classify_rhythm(rr).alias("rhythm")))[0]


@tool
def assess_signal_quality(session: Session, record_id: str) -> dict:
    x = F.col("signal")
    beats = F.size("beats")
    return _rows(_with_intervals(session, record_id).select(vt.snr_proxy(x).alias("snr"), vt.baseline_drift(x).alias("drift"), vt.usability(x, beats).alias("usability"), beats.alias("beats")))[0]


@tool
def assess_ppg_signal_quality(session: Session, record_id: str) -> dict:
    x = F.col("signal")
    score = vt.saturated(vt.snr_proxy(x), 5.0)
    return _rows(_record(session, record_id).select(F.round(score, 4).alias("score"), vt.quality_label(score).alias("quality"), sg.dominant_frequency(x, F.col("sampling_rate")).alias("dominant_frequency")))[0]


@tool
def state_build_from_ecg_record(session: Session, record_id: str, clear_existing: bool = False) -> dict:
    """One state of a recording, merged into the store."""
    rr = F.col("rr")
    built = _with_intervals(session, record_id).select(F.concat(F.lit("record:"), "record_id").alias("state_id"), F.lit("uploaded").alias("dataset"), F.lit("ecg").alias("modality"), F.col("record_id").alias("subject_id"), F.lit(0.0).alias("window_start_s"), (F.size("signal") / F.col("sampling_rate")).alias("window_end_s"), vt.heart_rate(rr).alias("hr_bpm"), vt.sdnn(rr).alias("sdnn_ms"), vt.rmssd(rr).alias("rmssd_ms"))
    filled = with_effective_keys(built.select(*(F.col(f.name) if f.name in built.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields)))
    kept = session.states.limit(0) if clear_existing else session.states.join(filled.select("state_id"), "state_id", "left_anti")
    session.states = kept.unionByName(filled)
    return {"state_id": f"record:{record_id}"}


@tool
def analyze_morphology(session: Session, record_id: str) -> dict:
    """Wave intervals of a recording, each against its usual range."""
    w = mo.wave_intervals(F.col("signal"), F.col("sampling_rate"))
    flags = {"qrs": ("qrs_ms", 80, 120), "pr": ("pr_ms", 120, 200), "qtc": ("qtc_ms", 350, 450)}
    found = _record(session, record_id).select(w.alias("w")).select("w.*", mo.findings(F.col("w")).alias("findings"), *(vt.range_flag(F.col(f"w.{c}"), low, high).alias(f"{k}_flag") for k, (c, low, high) in flags.items()))
    return _rows(found)[0]


@tool
def analyze_lead_morphology(session: Session, record_id: str, leads: str = "all") -> dict:
    """Findings of each lead of a multi-lead recording in standard order, and the growth of R over the chest leads."""
    every = session.recordings.where(F.col("metadata")["of"] == record_id)
    lead = F.col("metadata")["lead"]
    known = [r[0] for r in every.select(lead).distinct().collect()]
    wanted = [x for x in tx.LEADS if x in known] if leads == "all" else [x.strip() for x in leads.split(",")]
    unknown = [x for x in wanted if x not in known]
    if unknown or not wanted:
        raise ValueError(f"unknown leads {unknown} of {record_id}; known: {sorted(known)}")
    place = F.array_position(F.array(*(F.lit(x) for x in wanted)), lead)
    found = every.where(lead.isin(wanted)).select(place.alias("place"), lead.alias("lead"), mo.wave_intervals(F.col("signal"), F.col("sampling_rate")).alias("w")).select("place", "lead", "w.*", mo.findings(F.col("w")).alias("findings"))
    rows = _rows(found.orderBy("place"))
    heights = [r.get("r_mv", 0.0) for r in rows if r["lead"] in ("V1", "V2", "V3", "V4", "V5", "V6")]
    grown = session.spark.range(1).select(mo.r_progression(F.array(*(F.lit(float(h)) for h in heights)))).first()[0] if heights else None
    return {"leads": rows, "r_progression": grown}


@tool
def assess_all_leads_quality(session: Session, record_id: str) -> dict:
    """Quality of each lead and over all of them."""
    every = session.recordings.where(F.col("metadata")["of"] == record_id)
    score = vt.saturated(vt.snr_proxy(F.col("signal")), 5.0)
    each = every.select(F.col("metadata")["lead"].alias("lead"), score.alias("score"), vt.quality_label(score).alias("quality"))
    overall = each.agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("leads"), *(F.count_if(F.col("quality") == q).alias(q) for q in ("good", "acceptable", "poor")))
    return {"leads": _rows(each.orderBy("lead")), "overall": _rows(overall)[0]}


@tool
def list_ppg_records(session: Session, limit: int = 20) -> list[dict]:
    return list_ecg_records(session, limit)


@tool
def get_ppg_description(session: Session, record_id: str) -> str:
    return get_ecg_description(session, record_id)


@tool
def get_ppg_metadata(session: Session, record_id: str) -> dict:
    return get_ecg_metadata(session, record_id)


from . import tools_signal  # noqa: E402,F401  registers its tools
