"""Small functions over records: keys, headers, notes, leaks, summaries, traces and answers of a judge, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrain.schema import URGENCY

from .text import leads_named

#: Fields and key parts that come from labels, and keys that raw answers must not hold.
LABEL_FIELDS = ("rhythm_class", "previous_rhythm_class", "stress_label", "previous_stress_label", "protocol_label_id", "previous_protocol_label_id", "activity_label", "previous_activity_label", "af_burden_ratio", "stress_burden_ratio", "stress_duration_s", "dominant_stress_label", "rhythm_transition_count_per_hour", "stress_transition_count_per_hour", "rhythm_transition_count", "stress_transition_count")
LABEL_MARKERS = ("annotation", "ground_truth", "label", "protocol", "rhythm_gt", "rhythm_class_source", "rhythm_transition_source")
HIDDEN_KEYS = ("activity", "dominant_activity_fraction", "dominant_activity_label", "dominant_activity_label_id", "dominant_label_fraction", "dominant_protocol_label", "dominant_protocol_label_id", "ecg_reference_hr_label", "label_counts", "protocol_label")
#: What raw signals can tell about a target.
OBSERVABLE = ("af_presence_current", "heart_rate_category_current", "heart_rate_numeric_current", "heart_rate_higher_than_previous_window", "rhythm_changed_from_previous_window")
ANNOTATED = ("stress_presence_current", "stress_state_current", "protocol_label_id_query_current", "stress_state_changed_from_previous_window")
TOKEN_KEYS = ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")
PROVENANCE = ("source_variant", "hr_source", "mean_hr_bpm_source", "max_hr_bpm_source")

#: Phrases of diagnosis questions by what they ask for.
TRUSTED = ("atrial fibrillation", "atrial flutter", "sinus bradycardia", "sinus tachycardia", "sinus rhythm", "complete left bundle branch block", "incomplete left bundle branch block", "complete right bundle branch block", "incomplete right bundle branch block", "left anterior fascicular block", "left posterior fascicular block", "first degree av block", "1st degree av block", "left ventricular hypertrophy", "left atrial overload/enlargement", "left atrial enlargement", "right atrial overload/enlargement", "right atrial enlargement", "normal ecg", "digitalis effect")
DOUBTFUL = ("including uncertain symptoms", "excluding uncertain symptoms", "form-related", "what leads", "q wave", "q waves", "st depression", "st changes", "st segment", "t-wave", "t wave", "voltage criteria", "high qrs voltage", "long qt", "qt-interval", "qt interval", "prolonged qt", "qtc")
REGIONS = ("anterior", "inferior", "lateral", "posterior", "anteroseptal", "anterolateral", "inferolateral", "inferoposterior", "inferoposterolateral")
REGION_FINDINGS = ("myocardial infarction", "infarction", "infarct", "ischemic", "ischemia", "injury")
GENERAL = ("diagnostic symptom", "diagnostic symptoms", "form-related symptom", "form-related symptoms", "rhythm-related symptom", "rhythm-related symptoms", "show symptoms of")
LEAD_WORDS = (" in lead ", " in leads ", " lead ", " leads ")
LEAD_FINDINGS = ("symptom", "diagnostic", "form-related", "rhythm-related", "st ", "t-wave", "t wave", "q wave", "q waves", "inverted t", "ischemic", "injury", "infarct", "myocardial infarction", "voltage criteria")
INTERVALS = ("long qt", "qt-interval", "qt interval", "prolonged qt", "qtc")
WAVES = ("form-related", "q wave", "q waves", "st depression", "st changes", "st segment", "t-wave", "t wave", "voltage criteria", "high qrs voltage")


def segment_of(state_id: Column) -> Column:
    """Two-digit segment of a state id that names one as a whole part; null without."""
    digits = F.nullif(F.regexp_extract(state_id, r"(?:^|_)segment_(\d+)(?:_|$)", 1), F.lit(""))
    return F.when(F.length(digits) >= 2, digits).otherwise(F.lpad(digits, 2, "0"))


def started_at(moment: Column, day: Column, clock: Column) -> Column:
    """A header's start: the full moment, else day and time of day together; a day alone is none."""
    return F.coalesce(moment, F.try_to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock)))


def json_safe(value: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def context_key(own: Column, metadata: Column, specific: Column, names: tuple[str, ...], fallback: Column) -> Column:
    """The state's own key, else the first of the names among the metadata, else among the specific fields; empty is missing."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(own), *(filled(metadata[n]) for n in names), *(filled(specific[n]) for n in names), fallback)


def label_generated(fields: list[str], payloads: list[Column]) -> Column:
    """Whether a state shows facts that come from labels: a filled label field, or a key with a label marker."""
    shown = F.lit(False)
    for name in fields:
        shown = shown | F.col(name).isNotNull()
    for payload in payloads:
        shown = shown | F.exists(F.coalesce(F.map_keys(payload), F.array().cast("array<string>")), lambda k: F.lower(k).rlike("|".join(LABEL_MARKERS)))
    return shown


def without_keys(value: Column, kind: T.DataType, names: tuple[str, ...] = HIDDEN_KEYS) -> Column:
    """The nested value without fields and map keys of these names, at any depth of its type."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in names]
        return F.when(value.isNotNull(), F.struct(*(without_keys(value[f.name], f.dataType, names).alias(f.name) for f in kept)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_keys(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda k, v: ~k.isin(*names)), lambda k, v: without_keys(v, kind.valueType, names))
    return value


def supports_answer(target: Column, count: Column, peaks: Column, derived: Column, ratios: Column, kinds: Column, known: Column) -> Column:
    """Whether a trend's summary holds enough to answer its target."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return (
        F.when(target == "heart_rate_summary", some(count) | some(peaks))
        .when(target == "af_burden", some(count) | some(derived))
        .when(target == "stress_burden", some(derived) | some(ratios))
        .when(target == "activity_distribution", some(kinds))
        .otherwise(some(known))
    )


def observability(target: Column) -> Column:
    return F.when(target.isin(*OBSERVABLE), "raw_signal_observable").when(target.isin(*ANNOTATED), "annotation_grounded").otherwise("unknown")


def token_usage(usage: Column) -> Column:
    """All token counts of a map, missing ones as 0; without a positive total it is input and output."""
    count = lambda k: F.coalesce(usage[k].try_cast("bigint"), F.lit(0))
    total = F.when(count("total_tokens") > 0, count("total_tokens")).otherwise(count("input_tokens") + count("output_tokens"))
    return F.struct(*((total if k == "total_tokens" else count(k)).alias(k) for k in TOKEN_KEYS))


def actual_path(results: Column, signal_tools: tuple[str, ...], build_tool: str, query_prefix: str, ignored: str) -> Column:
    """Which way an answer took, from its calls (tool_name, success): signal_query, build_then_query, query, build or failure."""
    counted = F.filter(results, lambda r: ~r["tool_name"].eqNullSafe(F.lit(ignored)))
    part = lambda test: F.filter(counted, test)
    signal, build = part(lambda r: r["tool_name"].isin(*signal_tools)), part(lambda r: r["tool_name"] == build_tool)
    query = part(lambda r: r["tool_name"].startswith(query_prefix))
    good = lambda p: F.exists(p, lambda r: F.coalesce(r["success"], F.lit(False)))
    return (
        F.when(F.size(signal) > 0, F.when(good(signal), "signal_query").otherwise("failure"))
        .when(good(query), F.when(good(build), "build_then_query").otherwise("query"))
        .when(good(build), "build")
        .otherwise("failure")
    )


def hr_provenance(metadata: Column) -> Column:
    """Where a rate came from: the sources noted, and the label's source as the rate's, or beside it where they differ."""
    noted = F.map_filter(metadata, lambda k, v: k.isin(*PROVENANCE, "reference_signal") & v.isNotNull())
    label = metadata["hr_label_source"]
    place = F.when(metadata["hr_source"].isNull(), "hr_source").when(metadata["hr_source"] != label, "reference_hr_source")
    return F.when(label.isNotNull() & place.isNotNull(), F.map_concat(noted, F.create_map(F.coalesce(place, F.lit("")), label))).otherwise(noted)


def sample_notes(notes: Column, modality: Column, target: Column, caveat_targets: tuple[str, ...], caveat: str) -> Column:
    """The template's notes, and a caveat where the modality calls for it."""
    return F.concat_ws(" ", F.nullif(F.trim(F.coalesce(notes, F.lit(""))), F.lit("")), F.when((modality == "ppg") & target.isin(*caveat_targets), F.lit(caveat)))


def alert_explanation(rules: Column, reason: Column, episode: Column, latency: Column, is_false: Column) -> Column:
    """An alert in plain words."""
    aligned = F.concat(F.lit("The alert aligned with a "), episode, F.lit(" episode"), F.when(latency.isNotNull(), F.concat(F.lit(" about "), F.format_string("%.0f", latency), F.lit(" seconds after episode onset"))).otherwise(""), F.lit("."))
    return F.concat_ws(
        " ",
        F.when(F.size(rules) > 0, F.concat(F.lit("Triggered rule(s): "), F.array_join(rules, ", "), F.lit("."))),
        F.nullif(F.coalesce(reason, F.lit("")), F.lit("")),
        F.when(F.coalesce(episode, F.lit("")) != "", aligned),
        F.when(is_false, F.lit("Offline replay marked this alert as outside annotated abnormal episodes.")),
    )


def diagnosis_question(question: Column) -> Column:
    """How far a diagnosis network can be trusted with a question, and what else it takes."""
    text = F.array_join(F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != ""), " ")
    has = lambda words: text.rlike("|".join(re.escape(w) for w in words))
    leads = leads_named(question)
    facts = F.struct(
        text.alias("text"), leads.alias("leads"), has(TRUSTED).alias("trusted"), has(GENERAL).alias("general"), has(INTERVALS).alias("interval"), has(WAVES).alias("wave"), has(DOUBTFUL).alias("doubtful"),
        (has(REGIONS) & has(REGION_FINDINGS)).alias("region"), (((F.size(leads) > 0) | has(LEAD_WORDS)) & has(LEAD_FINDINGS)).alias("by_lead"),
    )

    def profile(f: Column) -> Column:
        narrow = f["region"] | f["interval"] | f["wave"]
        single = (F.array_join(f["leads"], ",") == "I") & f["trusted"] & f["by_lead"] & ~narrow
        low = f["doubtful"] | narrow | (f["by_lead"] & ~single)
        relevant = low | f["trusted"] | f["general"]
        return F.struct(
            relevant.alias("is_relevant"),
            F.when(single, "high").when(low, "low").when(f["trusted"], "high").when(relevant, "neutral").otherwise("none").alias("trust_level"),
            (low & (f["wave"] | f["by_lead"] | f["region"])).alias("needs_lead_morphology"),
            (low & f["interval"]).alias("needs_interval_morphology"),
            f["leads"].alias("leads"),
            f["text"].contains("including uncertain symptoms").alias("allows_uncertain_positive"),
            f["text"].contains("excluding uncertain symptoms").alias("ignores_uncertain_positive"),
            F.when(single, "single_lead").otherwise("12_lead").alias("mode"),
        )

    return F.transform(F.array(facts), profile)[0]


def judge_decision(answer: Column) -> Column:
    """A judge's JSON answer: texts cut, an unknown urgency is none, and none without an intervention; broken JSON is no alert."""
    kind = "intervene boolean, urgency string, reason string, advice string, cited_sections array<struct<guideline_id:string,section_id:string>>"
    parsed = F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")), kind)

    def of(j: Column) -> Column:
        go, urgency = F.coalesce(j["intervene"], F.lit(False)), F.lower(F.trim(j["urgency"]))
        cited = F.array_distinct(F.filter(F.coalesce(j["cited_sections"], F.array().cast("array<struct<guideline_id:string,section_id:string>>")), lambda c: (F.coalesce(c["guideline_id"], F.lit("")) != "") & (F.coalesce(c["section_id"], F.lit("")) != "")))
        return F.struct(go.alias("intervene"), F.when(go & urgency.isin(*URGENCY), urgency).otherwise("none").alias("urgency"), F.left(F.coalesce(j["reason"], F.lit("")), F.lit(500)).alias("reason"), F.left(F.coalesce(j["advice"], F.lit("")), F.lit(1000)).alias("advice"), cited.alias("cited_sections"))

    return F.transform(F.array(parsed), of)[0]


def predicted_class(label: Column) -> Column:
    """The four-class space: a missing label is Unknown, one that is not known is Other."""
    return F.when(label.isNull() | (label == ""), "Unknown").when(label.isin("N", "AF", "Other", "Unknown"), label).otherwise("Other")


def aligned_labels(beats: Column, labels: Column) -> Column:
    """Beats with their labels: both cut to the shorter, in the order of the beats, equal ones as they were."""
    n = F.least(F.size(beats), F.size(labels))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.get(beats, i - 1).alias("beat"), i.alias("place"), F.get(labels, i - 1).alias("label")))
    return F.transform(F.array_sort(F.slice(pairs, F.lit(1), n)), lambda p: F.struct(p["beat"].alias("beat"), p["label"].alias("label")))


def single_lead_name(name: Column, aliases: dict[str, str]) -> Column:
    """The standard name of a single lead; I without one."""
    clean = F.trim(F.replace(F.regexp_replace(F.upper(F.trim(name)), r"\s+", " "), F.lit("导联"), F.lit("")))
    bare = F.when(clean.startswith("LEAD"), F.trim(F.substr(clean, F.lit(5)))).otherwise(clean)
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[bare] if aliases else F.lit(None).cast("string")
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "I").otherwise(F.coalesce(known, bare))


def stats_features(values: Column, differences: bool) -> list[Column]:
    """Mean, spread, least, largest, range, mean size (and spread of differences); zeros without values."""
    from . import vitals as vt

    clean = vt.finite(values)
    found = [vt.mean(clean), vt.std(clean), F.array_min(clean), F.array_max(clean), F.array_max(clean) - F.array_min(clean), vt.mean(F.transform(clean, F.abs))]
    return [F.coalesce(c, F.lit(0.0)) for c in [*found, *([vt.std(vt.differences(clean))] if differences else [])]]


def trend_features(values: Column, duration: Column) -> list[Column]:
    """Mean, spread, least, largest, range, slope and mean step; zeros without values."""
    from . import vitals as vt

    clean = vt.finite(values)
    slope = F.when((F.size(clean) >= 2) & (duration > 0), (F.get(clean, F.size(clean) - 1) - F.get(clean, F.lit(0))) / duration)
    found = [vt.mean(clean), vt.std(clean), F.array_min(clean), F.array_max(clean), F.array_max(clean) - F.array_min(clean), slope, vt.mean(F.transform(vt.differences(clean), F.abs))]
    return [F.coalesce(c, F.lit(0.0)) for c in found]


def skips_activity(label: Column, fraction: Column, least: float = 0.8, transitions: tuple[str, ...] = ("transition", "unknown", "no_activity")) -> Column:
    """Whether an activity window is left out: in transition, or too mixed; one without a label stays."""
    return F.when(label.isNull(), False).otherwise(label.isin(*transitions) | (F.coalesce(fraction, F.lit(0.0)) < least))


def lead_of(signals: Column, wanted: Column) -> Column:
    """The signal of the lead asked for; a recording of one lead gives that; otherwise none."""
    return F.coalesce(signals[wanted], F.when(F.size(F.map_keys(signals)) == 1, F.get(F.map_values(signals), F.lit(0))))


def window_row(index: Column, start_s: Column, width_s: float, rates: dict[str, float], before: Column, end_before: Column) -> Column:
    """A window's wide metadata: sample bounds of each channel, the gap to the window before, and its id."""
    bounds = [c for name, rate in rates.items() for c in (F.bround(start_s * rate).cast("long").alias(f"{name}_start"), F.bround((start_s + width_s) * rate).cast("long").alias(f"{name}_end"))]
    return F.struct(index.alias("window_index"), start_s.alias("start_s"), (start_s + width_s).alias("end_s"), *bounds, (start_s - end_before).alias("gap_s"), before.alias("previous_id"))


def chosen_path(canonical: str, legacy: str, exists: dict[str, bool]) -> str:
    """The canonical place, unless only the legacy one is there."""
    return legacy if exists.get(legacy) and not exists.get(canonical) else canonical
