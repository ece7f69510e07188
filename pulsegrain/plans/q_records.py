"""Queries over records: keys, notes, leaks, summaries, traces, explanations and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrain.functions import records as rc
from pulsegrain.functions import vitals as vt
from pulsegrain.operators import catalogues as ct
from pulsegrain.operators import learn as ln
from pulsegrain.operators import monitoring as mt
from pulsegrain.operators import state as st

from .testdata_model import ORDER, SQL, table, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None, prefix: str = SQL):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = prefix + sql
        return function

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_ID = "CASE event_id % 4 WHEN 0 THEN 'a_segment_' || (event_id % 130) || '_w1' WHEN 1 THEN 'segment_7' WHEN 2 THEN 'xsegment_3' ELSE 'a_segment_' END"


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 130 < 10 THEN '0' ELSE '' END || (event_id % 130) WHEN 1 THEN '07' END AS segment FROM events", "")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", rc.segment_of(F.expr(_ID)).alias("segment"))


@query("SELECT event_id, epoch_us(CASE WHEN event_type = 'view' THEN ts WHEN event_type = 'click' THEN date_trunc('day', ts) + INTERVAL 45296 SECOND END) AS started FROM events", "")
def header_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    found = rc.started_at(F.when(kind == "view", ts), F.when(kind.isin("click", "error"), ts.cast("date")), F.when(kind != "error", F.lit("12:34:56")))
    return _events(spark, sf_dir).select("event_id", F.unix_micros(F.when(kind.isin("view", "click"), found)).alias("started"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS value FROM events", "")
def json_safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "signup", float("-inf")).otherwise(F.col("value"))
    return _events(spark, sf_dir).select("event_id", rc.json_safe(odd).alias("value"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'own' WHEN 1 THEN 'm-record' WHEN 2 THEN 'm-segment' WHEN 3 THEN 's-recording' ELSE 'subject' END AS recording FROM events""", "")
def context_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metadata names precede all specific ones; an empty key is missing."""
    k = F.col("event_id") % 5
    none = F.lit(None).cast("string")
    metadata = F.create_map(F.lit("record_id"), F.when(k == 1, "m-record"), F.lit("segment_id"), F.when(k.isin(1, 2), "m-segment").otherwise(""))
    specific = F.create_map(F.lit("recording_id"), F.when(k.isin(1, 2, 3), "s-recording").otherwise(none))
    found = rc.context_key(F.when(k == 0, "own").otherwise(""), metadata, specific, ("recording_id", "record_id", "segment_id"), F.lit("subject"))
    return _events(spark, sf_dir).select("event_id", found.alias("recording"))


@query("SELECT event_id, rhythm_class IS NOT NULL OR event_id % 3 = 0 AS shown FROM m")
def label_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.create_map(F.when(F.col("event_id") % 3 == 0, "Dominant_Label_x").otherwise("rate"), F.lit("1"))
    return windows(spark, sf_dir).select("event_id", rc.label_generated(["rhythm_class"], [payload]).alias("shown"))


@query("""SELECT event_id, '{"id":' || event_id || ',"windows":[{"start":' || (event_id % 7) || ',"inner":{"kept":"' || event_type || '"}},{"start":9,"inner":{"kept":"b"}}],"extra":{"rate":"4"}}' AS doc FROM events""", "")
def hidden_keys_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that would tell a label are gone at every depth."""
    inner = lambda kept: F.struct(F.lit("x").alias("activity"), kept.alias("kept"))
    part = lambda start, kept: F.struct(start.alias("start"), F.lit(1).alias("protocol_label"), inner(kept).alias("inner"))
    doc = F.struct(F.col("event_id").alias("id"), F.lit(0.5).alias("dominant_label_fraction"), F.array(part(F.col("event_id") % 7, F.col("event_type")), part(F.lit(9).cast("bigint"), F.lit("b"))).alias("windows"), F.create_map(F.lit("label_counts"), F.lit("3"), F.lit("rate"), F.lit("4")).alias("extra"))
    rows = _events(spark, sf_dir).select("event_id", doc.alias("doc"))
    return rows.select("event_id", F.to_json(rc.without_keys(F.col("doc"), rows.schema["doc"].dataType)).alias("doc"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN a > 0 OR b > 0 WHEN 1 THEN a > 0 OR c > 0 WHEN 2 THEN c > 0 OR b > 0 WHEN 3 THEN a > 0 ELSE c > 0 END AS answerable
FROM (SELECT event_id, event_id % 2 AS a, event_id % 3 AS b, CASE WHEN event_id % 7 > 0 THEN event_id % 4 ELSE 0 END AS c FROM events)""", "")
def answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = F.array(*(F.lit(t) for t in ("heart_rate_summary", "af_burden", "stress_burden", "activity_distribution", "other")))
    a, b, c = F.col("event_id") % 2, F.col("event_id") % 3, F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 4)
    found = rc.supports_answer(F.get(targets, (F.col("event_id") % 5).cast("int")), a, b, c, b, a, c)
    return _events(spark, sf_dir).select("event_id", found.alias("answerable"))


@query("""SELECT t AS target, CASE WHEN t LIKE 'stress%' OR t = 'protocol_label_id_query_current' THEN 'annotation_grounded' WHEN t = 'other' THEN 'unknown' ELSE 'raw_signal_observable' END AS kind, count(*) AS n
FROM (SELECT ['af_presence_current', 'stress_state_current', 'heart_rate_numeric_current', 'protocol_label_id_query_current', 'other'][1 + event_id % 5] AS t FROM events) GROUP BY ALL""", "")
def target_observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(t) for t in ("af_presence_current", "stress_state_current", "heart_rate_numeric_current", "protocol_label_id_query_current", "other")))
    rows = _events(spark, sf_dir).select(F.get(names, (F.col("event_id") % 5).cast("int")).alias("target"))
    return rows.groupBy("target", rc.observability(F.col("target")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, i AS input_tokens, 0 AS cached_input_tokens, o AS output_tokens, CASE WHEN event_id % 3 = 0 THEN 7 ELSE i + o END AS total_tokens
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 100 END AS i, event_id % 11 AS o FROM events)""", "")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    usage = F.create_map(F.lit("input_tokens"), F.when(F.col("event_type") != "error", e % 100), F.lit("output_tokens"), e % 11, F.lit("total_tokens"), F.when(e % 3 == 0, 7).otherwise(0).cast("bigint"))
    return _events(spark, sf_dir).select("event_id", rc.token_usage(usage).alias("u")).select("event_id", "u.*")


@query("SELECT sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(avg(i + o), 9) AS mean_total FROM (SELECT event_id % 100 AS i, event_id % 11 AS o FROM events)", "")
def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.create_map(F.lit("input_tokens"), F.col("event_id") % 100, F.lit("output_tokens"), F.col("event_id") % 11)
    rows = _events(spark, sf_dir).select(rc.token_usage(usage).alias("u")).select("u.*")
    return rows.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("total_tokens"), 9).alias("mean_total"))


@query("""SELECT event_id, CASE WHEN k = 0 THEN CASE WHEN ok THEN 'signal_query' ELSE 'failure' END WHEN k = 1 THEN CASE WHEN ok THEN 'build_then_query' ELSE 'build' END WHEN k = 2 THEN CASE WHEN ok THEN 'query' ELSE 'failure' END WHEN k = 3 THEN 'build' ELSE 'failure' END AS path
FROM (SELECT event_id, event_id % 5 AS k, value > 40 AS ok FROM events)""", "")
def actual_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, good = F.col("event_id") % 5, F.col("value") > 40
    call = lambda name, success: F.struct(F.lit(name).alias("tool_name"), success.alias("success"))
    calls = F.when(k == 0, F.array(call("signal", good))).when(k == 1, F.array(call("build", F.lit(True)), call("state_get", good))).when(k == 2, F.array(call("state_get", good), call("build", F.lit(False)))).when(k == 3, F.array(call("build", F.lit(True)))).otherwise(F.array(call("compared", F.lit(True))))
    return _events(spark, sf_dir).select("event_id", rc.actual_path(calls, ("signal",), "build", "state_", "compared").alias("path"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'hr_source=ecg' WHEN 1 THEN 'hr_source=label,reference_signal=bvp' ELSE 'hr_source=ecg,reference_hr_source=label' END AS evidence,
concat_ws(' ', CASE WHEN event_type = 'view' THEN 'noted' END, CASE WHEN event_id % 2 = 0 AND event_type IN ('view', 'click') THEN 'caveat' END) AS notes FROM events""", "")
def hr_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("event_id") % 3, F.lit(None).cast("string")
    metadata = F.create_map(F.lit("hr_source"), F.when(k != 1, "ecg"), F.lit("hr_label_source"), F.when(k == 0, "ecg").otherwise("label"), F.lit("reference_signal"), F.when(k == 1, "bvp").otherwise(none), F.lit("other"), F.lit("x"))
    entries = F.array_sort(F.transform(F.map_entries(rc.hr_provenance(metadata)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    notes = rc.sample_notes(F.when(F.col("event_type") == "view", " noted "), F.when(F.col("event_id") % 2 == 0, "ppg").otherwise("ecg"), F.col("event_type"), ("view", "click"), "caveat")
    return _events(spark, sf_dir).select("event_id", F.array_join(entries, ",").alias("evidence"), notes.alias("notes"))


@query("""SELECT event_id, concat_ws(' ', CASE WHEN event_type <> 'view' THEN 'Triggered rule(s): a' || CASE WHEN event_type = 'click' THEN ', b' ELSE '' END || '.' END, CASE WHEN event_id % 2 = 0 THEN 'Since so.' END,
CASE WHEN event_id % 3 = 0 THEN 'The alert aligned with a AF episode' || CASE WHEN event_id % 5 > 0 THEN ' about ' || (event_id % 5) || ' seconds after episode onset' ELSE '' END || '.' END,
CASE WHEN event_type = 'error' THEN 'Offline replay marked this alert as outside annotated abnormal episodes.' END) AS words FROM events""", "")
def alert_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    rules = F.when(kind == "view", F.array().cast("array<string>")).when(kind == "click", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    words = rc.alert_explanation(rules, F.when(e % 2 == 0, "Since so."), F.when(e % 3 == 0, "AF"), F.when(e % 5 > 0, (e % 5).cast("double")), kind == "error")
    return _events(spark, sf_dir).select("event_id", words.alias("words"))


#: Questions, and what is known of them by hand.
_QUESTIONS = [
    ("Does this ECG show symptoms of atrial fibrillation?", True, "high", False, False, "", "12_lead"),
    ("Does lead I show diagnostic symptoms of sinus rhythm?", True, "high", False, False, "I", "single_lead"),
    ("In lead V2, is there an inverted T?", True, "low", True, False, "V2", "12_lead"),
    ("Is there a prolonged  QT?", True, "low", False, True, "", "12_lead"),
    ("Signs of anterior infarction, including uncertain symptoms?", True, "low", True, False, "", "12_lead"),
    ("Which rhythm-related symptoms are there?", True, "neutral", False, False, "", "12_lead"),
    ("How old is the patient?", False, "none", False, False, "", "12_lead"),
]


@query("SELECT event_id, r AS is_relevant, t AS trust_level, l AS needs_lead_morphology, i AS needs_interval_morphology, d AS leads, m AS mode FROM events JOIN (VALUES " + ", ".join(f"({k}, {str(r).upper()}, '{t}', {str(a).upper()}, {str(i).upper()}, '{d}', '{m}')" for k, (_, r, t, a, i, d, m) in enumerate(_QUESTIONS)) + f") v(k, r, t, l, i, d, m) ON event_id % {len(_QUESTIONS)} = k", "")
def diagnosis_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*(F.lit(q[0]) for q in _QUESTIONS)), (F.col("event_id") % len(_QUESTIONS)).cast("int"))
    rows = _events(spark, sf_dir).select("event_id", rc.diagnosis_question(text).alias("p"))
    return rows.select("event_id", "p.is_relevant", "p.trust_level", "p.needs_lead_morphology", "p.needs_interval_morphology", F.array_join("p.leads", ",").alias("leads"), "p.mode")


@query("""SELECT event_id, coalesce(event_id % 4 IN (0, 1), FALSE) AS intervene, CASE event_id % 4 WHEN 0 THEN 'high' ELSE 'none' END AS urgency, CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 0 END AS reason_length, CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS cited FROM events""", "")
def judge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are well formed, of an unknown urgency, without an intervention, and broken."""
    k = F.col("event_id") % 4
    long = '{"intervene": true, "urgency": " HIGH ", "reason": "' + "r" * 600 + '", "cited_sections": [{"guideline_id": "g", "section_id": "1"}, {"guideline_id": "g", "section_id": "1"}, {"guideline_id": "g", "section_id": ""}, {"guideline_id": "h", "section_id": "2"}]}'
    answer = F.when(k == 0, "Well: " + long).when(k == 1, '{"intervene": true, "urgency": "soon", "reason": "abc"}').when(k == 2, '{"intervene": false, "urgency": "high", "reason": "abc"} so far').otherwise("no {json here")
    rows = _events(spark, sf_dir).select("event_id", rc.judge_decision(answer).alias("j"))
    return rows.select("event_id", "j.intervene", "j.urgency", F.length("j.reason").alias("reason_length"), F.size("j.cited_sections").alias("cited"))


@query("SELECT CASE event_type WHEN 'view' THEN 'N' WHEN 'click' THEN 'AF' WHEN 'error' THEN 'Unknown' WHEN 'signup' THEN 'Unknown' ELSE 'Other' END AS label, count(*) AS n FROM events GROUP BY ALL", "")
def predicted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", "N").when(F.col("event_type") == "click", "AF").when(F.col("event_type") == "purchase", "VT").when(F.col("event_type") == "signup", "")
    return _events(spark, sf_dir).groupBy(rc.predicted_class(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT subject_id, string_agg(b || ':' || l, ',' ORDER BY b, p) AS pairs FROM (SELECT subject_id, b[p] AS b, l[p] AS l, p FROM (SELECT subject_id, b, l, unnest(generate_series(1, least(len(b), len(l)))) AS p
FROM (SELECT subject_id, list((event_id * 7) % 50 ORDER BY off_us, event_id) AS b, list(window_index % 3 ORDER BY off_us, event_id) FILTER (window_index % 4 > 0) AS l FROM m GROUP BY ALL))) GROUP BY ALL""")
def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    listed = rows.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "window_index"))).alias("r"))
    beats, labels = F.transform("r", lambda x: (x["event_id"] * 7) % 50), F.transform(F.filter("r", lambda x: x["window_index"] % 4 > 0), lambda x: x["window_index"] % 3)
    pairs = F.transform(rc.aligned_labels(beats, labels), lambda p: F.concat_ws(":", p["beat"], p["label"]))
    return listed.select("subject_id", F.array_join(pairs, ",").alias("pairs")).where("pairs <> ''")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'V1' WHEN 3 THEN 'I' ELSE 'X 9' END AS lead FROM events", "")
def single_lead_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("  "), F.lit("Lead  ii"), F.lit("V1导联"), F.lit("one"), F.lit("x  9"))
    return _events(spark, sf_dir).select("event_id", rc.single_lead_name(F.get(names, (F.col("event_id") % 5).cast("int")), {"ONE": "I"}).alias("lead"))


@query("SELECT event_id, greatest(CASE WHEN event_type <> 'view' THEN value END, CASE WHEN event_type <> 'click' THEN value / 2 + 100 END, 60) AS max_hr FROM events", "")
def pulse_bundle_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest of the known estimates of a window's rate."""
    v, kind = F.col("value"), F.col("event_type")
    return _events(spark, sf_dir).select("event_id", F.greatest(F.when(kind != "view", v), F.when(kind != "click", v / 2 + 100), F.lit(60.0)).alias("max_hr"))


_LIST = ", ls AS (SELECT subject_id, list(value ORDER BY off_us, event_id) AS l, count(*) / 4.0 AS d FROM m GROUP BY ALL)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = windows(spark, sf_dir).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "value"))).alias("r"))
    return listed.select("subject_id", F.transform("r", lambda x: x["value"]).alias("l"), (F.size("r") / 4.0).alias("d"))


_STATS = ["list_avg(l)", "list_stddev_pop(l)", "list_min(l)", "list_max(l)", "list_max(l) - list_min(l)"]
_STEP = "list_transform(range(2, len(l) + 1), lambda k: {})"


@query("SELECT subject_id, " + ", ".join(f"round({s}, 6) AS f{k}" for k, s in enumerate([*_STATS, "list_avg(list_transform(l, lambda x: abs(x)))", f"coalesce(list_stddev_pop({_STEP.format('l[k] - l[k - 1]')}), 0)"])) + " FROM ls", SQL + _LIST)
def window_stats_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("subject_id", *(F.round(c, 6).alias(f"f{k}") for k, c in enumerate(rc.stats_features(F.col("l"), True))))


@query("SELECT subject_id, " + ", ".join(f"round({s}, 6) AS f{k}" for k, s in enumerate([*_STATS, "CASE WHEN len(l) >= 2 THEN (l[-1] - l[1]) / d ELSE 0 END", f"coalesce(list_avg({_STEP.format('abs(l[k] - l[k - 1])')}), 0)"])) + " FROM ls", SQL + _LIST)
def window_trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("subject_id", *(F.round(c, 6).alias(f"f{k}") for k, c in enumerate(rc.trend_features(F.col("l"), F.col("d")))))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, rhythm_class ORDER BY off_us) AS n FROM m WHERE value >= 30 AND rhythm_class IS NOT NULL) WHERE n <= 4")
def clean_training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four windows of each subject and label, the earliest clean ones."""
    return ln.clean_windows(windows(spark, sf_dir), "rhythm_class", "value", 30, ["subject_id"], "off_us", 4).select("event_id")


@query("SELECT subject_id, count(*) FILTER (k % 3 <> 0) AS kept, count(*) FILTER (k % 3 = 0) AS excluded FROM (SELECT *, subject_id % 7 AS k FROM m) GROUP BY ALL HAVING count(*) FILTER (k % 3 <> 0) > 0")
def training_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the training subjects, without those held out."""
    rows = windows(spark, sf_dir)
    held = rows.where((F.col("subject_id") % 7) % 3 == 0).select("subject_id").distinct()
    kept = rows.join(held, "subject_id", "left_anti")
    ln.guard(kept.select("subject_id").distinct(), held, "subject_id")
    return kept.groupBy("subject_id").agg(F.count(F.lit(1)).alias("kept"), F.lit(0).cast("bigint").alias("excluded"))


@query("""SELECT subject_id, count(*) AS beats, CASE WHEN count(*) - 1 < 5 THEN 'Unknown' WHEN stddev_pop(d) / avg(d) < 0.05 THEN 'N' ELSE '?' END AS label FROM (SELECT subject_id, off_us, (off_us - lag(off_us) OVER (PARTITION BY subject_id ORDER BY off_us, event_id)) / 1e9 AS d FROM m WHERE off_us >= 864000000000 AND off_us < 1036800000000) GROUP BY ALL""")
def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of a locator window and, from their intervals, the rhythm; only its sure cases are compared."""
    inside = windows(spark, sf_dir).where("off_us >= 864000000000 AND off_us < 1036800000000")
    listed = inside.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.col("off_us") / 1e9)).alias("b"))
    rr = vt.differences(F.col("b"))
    label = F.when(F.size("b") - 1 < 5, vt.classify_rhythm(rr)).when(vt.variation(rr) < 0.05, "N").otherwise("?")
    return listed.select("subject_id", F.size("b").cast("bigint").alias("beats"), label.alias("label"))


@query("SELECT s_suppkey, count(*) AS windows, round(avg(p_retailprice), 6) AS mean_rate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_acctbal > 0 GROUP BY ALL", "")
def recording_aggregate_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of a recording over the windows that stay."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    kept = rows.join(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"))
    return kept.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("p_retailprice"), 6).alias("mean_rate"))


@query("SELECT event_id, round(CASE WHEN value < 200 THEN a ELSE (a + value / 500) / 2 END, 6) AS quality FROM (SELECT event_id, value, (value % 10) / 10 AS a FROM events)", "")
def lead_quality_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the scores that a lead has."""
    a, b = (F.col("value") % 10) / 10, F.when(F.col("value") >= 200, F.col("value") / 500)
    return _events(spark, sf_dir).select("event_id", F.round(vt.weighted_quality([(a, 1.0), (b, 1.0)]), 6).alias("quality"))


@query("SELECT event_type AS kind, count(*) AS leads, round(avg(value), 6) AS mean, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS names FROM events WHERE value < 40 GROUP BY ALL", "")
def cross_lead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("value < 40")
    found = rows.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("leads"), F.round(F.avg("value"), 6).alias("mean"), F.array_sort(F.collect_set("user_id")).alias("names"))
    return found.withColumn("names", F.array_join(F.col("names").cast("array<string>"), ","))


@query("SELECT event_id, CASE WHEN off_us < 864000000000 THEN 'first' WHEN event_id % 97 = 3 THEN 'curated' END AS note FROM m")
def curated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a curated list beside defaults."""
    listed = spark.createDataFrame([(3, "curated")], "slot long, note string")
    rows = windows(spark, sf_dir).withColumn("slot", F.col("event_id") % 97).join(F.broadcast(listed), "slot", "left")
    return rows.select("event_id", F.when(F.col("off_us") < 864_000_000_000, "first").otherwise(F.col("note")).alias("note"))


@query("""SELECT rhythm_class, event_type, recording_id, subject_id % 4 AS arm, value > 100 AS high, count(*) AS n FROM m GROUP BY GROUPING SETS ((rhythm_class), (event_type), (recording_id), (subject_id % 4), (value > 100))""")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by each of five columns in one pass."""
    rows = windows(spark, sf_dir).select("rhythm_class", "event_type", "recording_id", (F.col("subject_id") % 4).alias("arm"), (F.col("value") > 100).alias("high"))
    names = ["rhythm_class", "event_type", "recording_id", "arm", "high"]
    return rows.groupingSets([[F.col(c)] for c in names], *(F.col(c) for c in names)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 97 END AS age FROM customer) WHERE age <= 40", "")
def uploaded_record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown age fails an upper bound too."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 97 END AS age", "CAST(NULL AS STRING) AS sex")
    return ct.search(rows, "age", "sex", None, 40, None).select("c_custkey")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN FALSE WHEN 'click' THEN TRUE ELSE value < 80 END AS skipped FROM events", "")
def activity_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", "transition").when(kind != "view", "walking")
    return _events(spark, sf_dir).select("event_id", rc.skips_activity(label, F.col("value") / 100).alias("skipped"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2.0 WHEN 1 THEN value END AS first_sample FROM events", "")
def lead_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead asked for, the only one, or none."""
    k = F.col("event_id") % 3
    two = F.create_map(F.lit("I"), F.array(F.lit(1.0)), F.lit("II"), F.array(F.lit(2.0)))
    signals = F.when(k == 1, F.create_map(F.lit("I"), F.array("value"))).otherwise(two)
    found = rc.lead_of(signals, F.when(k == 2, "V9").otherwise("II"))
    return _events(spark, sf_dir).select("event_id", F.get(found, F.lit(0)).alias("first_sample"))


@query("""SELECT event_id, window_index, round_even(value * 64, 0)::BIGINT AS bvp_start, round_even((value + 30) * 64, 0)::BIGINT AS bvp_end, round(value - lag(value + 30) OVER w, 6) AS gap_s, lag(event_id) OVER w AS previous_id FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)""")
def wide_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of windows with the sample bounds of a channel."""
    w = Window.partitionBy("subject_id").orderBy(*ORDER)
    row = rc.window_row(F.col("window_index"), F.col("value"), 30.0, {"bvp": 64.0}, F.col("prior"), F.col("ended"))
    rows = windows(spark, sf_dir).withColumns({"prior": F.lag("event_id").over(w), "ended": F.lag(F.col("value") + 30).over(w)}).select("event_id", row.alias("r"))
    return rows.select("event_id", "r.window_index", "r.bvp_start", "r.bvp_end", F.round("r.gap_s", 6).alias("gap_s"), "r.previous_id")


@query("""SELECT subject_id, 'ecg' AS segment_id, greatest(b, 100000000000) AS span_start, least(e, 900000000000) AS span_end, label FROM (SELECT subject_id, off_us AS b, lead(off_us) OVER w AS e, rhythm_class AS label FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id))
WHERE label IS NOT NULL AND b < 900000000000 AND e > 100000000000""")
def reference_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference recording as one segment: its rhythm spans clipped to a sample range."""
    low, high = 100_000_000_000, 900_000_000_000
    spans = mt.beat_intervals(windows(spark, sf_dir), ["subject_id"], ORDER, "off_us", "rr_ms", "rhythm_class").where("label IS NOT NULL")
    inside = st.overlapping(spans, low, high, "start", "end")
    return inside.select("subject_id", F.lit("ecg").alias("segment_id"), F.greatest("start", F.lit(low)).cast("bigint").alias("span_start"), F.least("end", F.lit(high)).cast("bigint").alias("span_end"), "label")
