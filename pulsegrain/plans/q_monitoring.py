"""Queries over longer views of a timeline: variability, episodes, trends and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.functions import vitals as vt
from pulsegrain.operators import annotations as an
from pulsegrain.operators import catalogues as ct
from pulsegrain.operators import evaluate as ev
from pulsegrain.operators import monitoring as mo
from pulsegrain.operators import sequence as seq

from . import q_evaluate, q_vitals
from .testdata_model import ORDER, SQL, table, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LINE = ["subject_id", "recording_id"]
_W = "(PARTITION BY subject_id ORDER BY off_us, event_id)"


def query(sql: str | None, prefix: str = SQL):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = prefix + sql
        return function

    return register


_BEATS = """, bc AS (SELECT *, count(*) OVER (PARTITION BY subject_id, recording_id) AS n, lead(off_us) OVER w AS nx, coalesce(sum(rr_ms) OVER (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM m WINDOW w AS (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id))
SELECT subject_id, recording_id, rhythm_class AS label, round(CASE WHEN n > 1 THEN off_us ELSE before END / 1e6, 6) AS start, round(CASE WHEN n > 1 THEN nx ELSE before + rr_ms END / 1e6, 6) AS end FROM bc WHERE CASE WHEN n > 1 THEN nx > off_us ELSE rr_ms > 0 END"""


@query(_BEATS)
def beat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mo.beat_intervals(windows(spark, sf_dir), LINE, ORDER, "off_us", "rr_ms", "rhythm_class")
    return found.select(*LINE, "label", F.round(F.col("start") / 1e6, 6).alias("start"), F.round(F.col("end") / 1e6, 6).alias("end"))


_HRV = """, i AS (SELECT subject_id, off_us, event_id, 1 AS p, 200 + 5 * value AS x FROM m WHERE event_type <> 'view' UNION ALL SELECT subject_id, off_us, event_id, 2, 700 + value FROM m WHERE event_type <> 'view'),
b AS (SELECT *, list(x) OVER (PARTITION BY subject_id ORDER BY off_us, event_id, p ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS a FROM i),
c AS (SELECT subject_id, off_us, event_id, list_filter(a, lambda x: x BETWEEN 300 AND 2000) AS l FROM b WHERE p = 2),
v AS (SELECT *, CASE WHEN len(l) >= 3 THEN round(list_stddev_samp(l), 4) END AS sd, CASE WHEN len(l) >= 3 THEN round(sqrt(list_avg(list_transform(range(2, len(l) + 1), lambda k: pow(l[k] - l[k - 1], 2)))), 4) END AS rm, len(l) AS n FROM c)
SELECT m.event_id, last_value(CASE WHEN v.n IS NOT NULL THEN {'a': v.sd} END IGNORE NULLS) OVER w['a'] AS sdnn, last_value(CASE WHEN v.n IS NOT NULL THEN {'a': v.rm} END IGNORE NULLS) OVER w['a'] AS rmssd, last_value(v.n IGNORE NULLS) OVER w AS intervals
FROM m LEFT JOIN v USING (event_id) WINDOW w AS (PARTITION BY m.subject_id ORDER BY m.off_us, m.event_id)""".replace("OVER w['a']", "OVER w").replace("SELECT m.event_id, last_value", "SELECT event_id, s['a'] AS sdnn, r['a'] AS rmssd, intervals FROM (SELECT m.event_id, last_value", 1).replace("OVER w AS sdnn", "OVER w AS s").replace("OVER w AS rmssd", "OVER w AS r") + ")"


@query(_HRV)
def medium_hrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).withColumn("rr", F.when(F.col("event_type") != "view", F.array(200 + 5 * F.col("value"), 700 + F.col("value"))))
    return mo.medium_hrv(rows, ["subject_id"], ORDER, "rr", 40).select("event_id", F.round("sdnn", 4).alias("sdnn"), F.round("rmssd", 4).alias("rmssd"), "intervals")


#: Episodes over the rule layer's rows `x`.
_LOG = q_vitals._TRACK + f""", a0 AS (SELECT *, rules <> '' AS active, CASE urgency WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS place FROM x),
a1 AS (SELECT *, CASE WHEN active IS DISTINCT FROM lag(active) OVER {_W} THEN 1 ELSE 0 END AS s, active AND NOT coalesce(lag(active) OVER {_W}, FALSE) AS began FROM a0),
a2 AS (SELECT *, sum(s) OVER {_W} AS run FROM a1),
a3 AS (SELECT subject_id, run, any_value(active) AS active, min(window_index) AS start_index, min(off_us) AS start_at, arg_min(urgency, window_index) AS urgency_initial, max(place) AS top, arg_min(place, window_index) AS p0,
arg_min(string_split(rules, ',')[1], window_index) AS episode_type, arg_min(value, window_index) AS vitals_at_start, arg_min(value, (-place, window_index)) AS vitals_at_peak FROM a2 GROUP BY ALL),
a4 AS (SELECT *, lead(start_index) OVER (PARTITION BY subject_id ORDER BY run) AS end_index, lead(start_at) OVER (PARTITION BY subject_id ORDER BY run) AS end_at FROM a3),
ru AS (SELECT subject_id, run, string_agg(rule, ',' ORDER BY f, rule) AS rules FROM (SELECT subject_id, run, rule, min(window_index) AS f FROM (SELECT subject_id, run, window_index, unnest(string_split(rules, ',')) AS rule FROM a2 WHERE active) GROUP BY ALL) GROUP BY ALL),
lg AS (SELECT a4.*, ru.rules, row_number() OVER (PARTITION BY subject_id ORDER BY run) - 1 AS episode, CASE top WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS urgency_max,
top > p0 AS was_escalated, CASE WHEN end_index IS NULL THEN 'active' ELSE 'resolved' END AS status FROM a4 JOIN ru USING (subject_id, run) WHERE active)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.episode_log(q_vitals._evaluated(spark, sf_dir), ["subject_id"], ORDER, "window_index", "off_us", "value")


@query("SELECT subject_id, episode, episode_type, urgency_initial, urgency_max, was_escalated, status, start_index, end_index, start_at, end_at, vitals_at_start, vitals_at_peak FROM lg", SQL + _LOG)
def episode_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).drop("rules")


@query("SELECT subject_id, episode, array_to_string(list_sort(string_split(rules, ',')), ',') AS rules FROM lg", SQL + _LOG)
def episode_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("subject_id", "episode", F.array_join(F.array_sort("rules"), ",").alias("rules"))


@query(f"SELECT event_id, sum(began::INT) OVER (PARTITION BY subject_id ORDER BY off_us, event_id ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM a1", SQL + _LOG)
def recent_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.recent_episodes(q_vitals._evaluated(spark, sf_dir), ["subject_id"], ORDER, 12).select("event_id", "recent")


@query("SELECT subject_id, episode_type, max(episode) AS episode, arg_max(status, episode) AS status, arg_max(start_at, episode) AS start_at FROM lg GROUP BY ALL", SQL + _LOG)
def last_episode_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.last_episode(_log(spark, sf_dir), ["subject_id"])


@query("SELECT subject_id, count(*) AS windows, count(*) FILTER (active) AS active_windows, min(off_us) AS first_at, max(off_us) AS last_at FROM a0 GROUP BY ALL", SQL + _LOG)
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.replay_summary(q_vitals._evaluated(spark, sf_dir), ["subject_id"], "off_us", F.size("triggered") > 0)


_ALERTS = q_evaluate._RUNS.replace("{tolerance}", "0")
_PLACED = _ALERTS.partition("SELECT subject_id, event_id, episode, CASE")[0] + ", pl AS (" + "SELECT subject_id, event_id, episode, off_us, CASE" + _ALERTS.partition("SELECT subject_id, event_id, episode, CASE")[2] + ")"


@query("SELECT subject_id, count(*) AS total, count(*) FILTER (outcome = 'false') AS false_alerts, count(*) FILTER (outcome = 'hit') AS matched, max(off_us) AS last_at FROM pl GROUP BY ALL", SQL + _PLACED)
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = q_evaluate._alerts(spark, sf_dir, 0).join(windows(spark, sf_dir).select("event_id", "off_us"), "event_id")
    return ct.alert_summary(placed, ["subject_id"], "outcome", "off_us")


@query("SELECT subject_id, coalesce(rule_id, '(none)') AS rule_id, count(*) AS alerts FROM (SELECT subject_id, unnest(CASE WHEN rules = '' THEN [NULL] ELSE string_split(rules, ',') END) AS rule_id FROM x WHERE rules <> '' OR event_type = 'error') GROUP BY ALL", SQL + q_vitals._TRACK)
def alerts_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.alerts_by_rule(q_vitals._evaluated(spark, sf_dir).where("size(triggered) > 0 OR event_type = 'error'"), ["subject_id"], "triggered")


@query("""SELECT (SELECT count(*) FROM m) AS windows, count(*) AS events, e AS episodes, count(*) FILTER (outcome = 'hit') AS matched, e - count(*) FILTER (outcome = 'hit') AS missed, count(*) FILTER (outcome = 'false') AS false_alerts,
count(*) FILTER (outcome = 'duplicate') AS duplicates, round(count(*) FILTER (outcome = 'hit') / count(*), 9) AS precision, round(count(*) FILTER (outcome = 'hit') / e, 9) AS recall, round(2.0 * count(*) FILTER (outcome = 'hit') / (count(*) + e), 9) AS f1,
round(avg(latency) FILTER (outcome = 'hit'), 3) AS latency_mean, round(quantile_cont(latency, 0.5) FILTER (outcome = 'hit'), 3) AS latency_median, round(quantile_cont(latency, 0.9) FILTER (outcome = 'hit'), 3) AS latency_p90, max(latency) FILTER (outcome = 'hit') AS latency_max
FROM (SELECT pl.*, pl.off_us - ep.run_start AS latency FROM pl LEFT JOIN ep ON pl.subject_id = ep.subject_id AND pl.episode = ep.episode), (SELECT count(*) AS e FROM ep) GROUP BY e""", SQL + _PLACED)
def intervention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    found = seq.episodes(rows, ["subject_id"], ORDER, "rhythm_class", ["AF", "Other"], "off_us", "end_us").withColumn("episode", F.col("episode").cast("long"))
    placed = ev.match_alerts(found, rows.where("hr_bpm > 200"), ["subject_id"], "episode", ("run_start", "run_end"), "off_us", "event_id", 0)
    report = mo.intervention_report(F.lit(rows.count()), found.select("subject_id", "episode", "run_start"), placed, ["subject_id"], "run_start", "off_us")
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")} | {c: F.round(c, 3) for c in ("latency_mean", "latency_median", "latency_p90")})


_SNAP = f""", sn AS (SELECT subject_id, n // 5 AS snapshot, min(n) AS first_window, max(n) AS last_window, min(off_us) AS first_at, max(off_us) AS last_at, avg(hr_bpm) AS mean_hr, count(*) FILTER (event_type = 'error') AS anomalies
FROM (SELECT *, row_number() OVER {_W} - 1 AS n FROM m) GROUP BY ALL)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.trend_snapshots(windows(spark, sf_dir), ["subject_id"], ORDER, 5, "off_us", "hr_bpm", F.col("event_type") == "error")


@query("SELECT subject_id, snapshot, first_window, last_window, first_at, last_at, round(mean_hr, 6) AS mean_hr, anomalies FROM sn", SQL + _SNAP)
def trend_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).withColumn("mean_hr", F.round("mean_hr", 6))


@query("""SELECT subject_id, count(*) AS snapshots, round(min(mean_hr), 6) AS hr_low, round(max(mean_hr), 6) AS hr_high, sum(anomalies)::BIGINT AS total_anomalies, CASE WHEN count(*) >= 8 THEN round(avg(mean_hr) FILTER (r <= 4), 6) END AS recent_hr,
CASE WHEN count(*) >= 8 THEN round(avg(mean_hr) FILTER (r BETWEEN 5 AND 8), 6) END AS previous_hr, CASE WHEN count(*) >= 8 THEN (sum(anomalies) FILTER (r <= 4) - sum(anomalies) FILTER (r BETWEEN 5 AND 8))::BIGINT END AS anomaly_delta
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY snapshot DESC) AS r FROM sn) GROUP BY ALL""", SQL + _SNAP)
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.trend_summary(_snapshots(spark, sf_dir), ["subject_id"]).withColumns({c: F.round(c, 6) for c in ("hr_low", "hr_high", "recent_hr", "previous_hr")})


@query("SELECT subject_id, n AS windows, n >= 30 AND hr IS NOT NULL AND n >= 3 AS numeric_ready FROM (SELECT subject_id, count(*) AS n, max(hr_bpm) AS hr FROM m GROUP BY ALL)")
def baseline_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of the personal baseline after the whole timeline."""
    rows = windows(spark, sf_dir).withColumn("rr", F.array("rr_ms"))
    hrv = seq.keep_last(mo.medium_hrv(rows, ["subject_id"], ORDER, "rr"), ["subject_id"], ORDER, 1).select("subject_id", "sdnn", "rmssd")
    rest = seq.ema_skip(rows, ["subject_id"], ORDER, "hr_bpm")
    total = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("windows"))
    return mo.baseline_snapshot(total.join(hrv, "subject_id").join(rest, "subject_id", "left")).select("subject_id", "windows", "numeric_ready")


@query(f"""SELECT s.subject_id, round(c * 3600.0 / nullif(t, 0), 9) AS per_hour, coalesce(round(c * 3600.0 / nullif(t, 0), 9), 0) AS per_hour_or_zero FROM (SELECT subject_id, (max(off_us) - min(off_us)) / 1e6 AS t FROM m GROUP BY ALL) s
LEFT JOIN (SELECT subject_id, count(*) FILTER (f <> rhythm_class) AS c FROM (SELECT *, lag(rhythm_class) OVER {_W} AS f FROM m WHERE rhythm_class IS NOT NULL) GROUP BY ALL) USING (subject_id)""")
def transition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mo.transition_rate(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", (F.max("off_us") - F.min("off_us")) / 1e6)
    return found.withColumns({c: F.round(c, 9) for c in ("per_hour", "per_hour_or_zero")})


@query("SELECT subject_id, CASE WHEN r IS NULL THEN NULL WHEN r <= 0 THEN 'stable' WHEN r <= 3 THEN 'occasional_changes' ELSE 'frequent_changes' END AS label FROM (SELECT subject_id, (count(*) % 9) - 3 AS r FROM m GROUP BY ALL)")
def variability_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).groupBy("subject_id").agg((F.count(F.lit(1)) % 9 - 3).alias("r")).select("subject_id", vt.variability_label(F.col("r")).alias("label"))


@query("SELECT subject_id, min(off_us) AS first_start, max(end_us) AS last_end FROM m WHERE rhythm_class IS NOT NULL GROUP BY ALL")
def annotation_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.annotation_bounds(windows(spark, sf_dir).where("rhythm_class IS NOT NULL"), ["subject_id"], "off_us", "end_us")


_HALF = f""", hd AS (SELECT subject_id, sum(rr_ms) / 1000 * 0.9 AS d FROM m GROUP BY ALL),
ht AS (SELECT subject_id, sum(rr_ms / 1000) OVER {_W} AS t FROM m UNION ALL SELECT DISTINCT subject_id, 0 FROM m)
SELECT subject_id, floor(t / 30)::BIGINT AS half_minute, round(count(*) * 2.0, 6) AS bpm FROM ht JOIN hd USING (subject_id) WHERE t < d AND (floor(t / 30) + 1) * 30 <= d + 1e-9 GROUP BY ALL HAVING count(*) >= 2"""


@query(_HALF)
def half_minute_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    total = rows.groupBy("subject_id").agg((F.sum("rr_ms") / 1000 * 0.9).alias("seconds"))
    return mo.half_minute_rates(rows.join(total, "subject_id"), ["subject_id"], ORDER, "rr_ms", "seconds").withColumn("bpm", F.round("bpm", 6))


@query("""SELECT subject_id, round(CASE WHEN b IS NULL THEN n / h ELSE n / ((b + h) / 2) END, 9) AS rate, round(least(coalesce(b, h), h, n / 4.0), 9) AS seconds
FROM (SELECT subject_id, count(*) * 4 AS n, count(*) / 0.5 AS h, CASE WHEN subject_id % 3 <> 0 THEN (count(*) * 130 + subject_id) / 64.0 END AS b FROM m GROUP BY subject_id)""")
def sampling_rate_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    sizes = windows(spark, sf_dir).groupBy("subject_id").agg((n * 4).alias("n"), (n / 0.5).alias("h"), n.alias("c"))
    b = F.when(F.col("subject_id") % 3 != 0, (F.col("c") * 130 + F.col("subject_id")) / 64.0)
    return sizes.select("subject_id", F.round(mo.inferred_rate(F.col("n"), [b, F.col("h")], 4.0), 9).alias("rate"), F.round(mo.shortest([b, F.col("h"), F.col("n") / 4.0]), 9).alias("seconds"))


@query(f"""SELECT subject_id, greatest(0, off_us - 1200000000) AS start FROM (SELECT subject_id, off_us, row_number() OVER (PARTITION BY subject_id ORDER BY off_us) AS n FROM (SELECT *, lag(rhythm_class) OVER {_W} AS f, row_number() OVER {_W} AS k FROM m) WHERE k = 1 OR f IS DISTINCT FROM rhythm_class) WHERE n = 2""")
def replay_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = seq.change_markers(windows(spark, sf_dir), ["subject_id"], ORDER, "off_us", "rhythm_class", F.lit(1 << 60))
    return mo.first_change_start(marks, ["subject_id"], "off_us", 8, 600_000_000)


# --- annotations --------------------------------------------------------------------------------

_NOTE = "CASE event_type WHEN 'view' THEN '(N' WHEN 'click' THEN '(AFIB' WHEN 'purchase' THEN ')' WHEN 'signup' THEN '(' ELSE '+' END"


@query(f"""SELECT subject_id, span_start, least(coalesce(nx, {31 * 86_400_000_000}), {31 * 86_400_000_000}) AS span_end, substr(note, 2) AS label
FROM (SELECT *, lead(off_us) OVER (PARTITION BY subject_id ORDER BY off_us, window_index) AS nx, off_us AS span_start FROM (SELECT *, {_NOTE} AS note FROM m) WHERE starts_with(note, '(') OR note = ')') WHERE starts_with(note, '(') AND note <> '('
AND least(coalesce(nx, {31 * 86_400_000_000}), {31 * 86_400_000_000}) > span_start""")
def marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = windows(spark, sf_dir).select("subject_id", "off_us", F.col("window_index").alias("position"), F.expr(_NOTE).alias("note"), F.lit(31 * 86_400_000_000).alias("total"))
    return an.marker_spans(marks, ["subject_id"], "off_us", "note", "total")


@query(f"SELECT event_id, CASE note WHEN '(N' THEN 'N' WHEN '(AFIB' THEN 'AF' END AS label FROM (SELECT event_id, {_NOTE} AS note FROM m)")
def marker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("event_id", an.map_label(F.expr(_NOTE)).alias("label"))


_DAYS = """, dy AS (SELECT subject_id, off_us, event_id, (off_us // 3600000000) % 24 AS clock, CASE WHEN event_type IN ('view', 'error') THEN off_us // 86400000000 END AS day FROM m),
dc AS (SELECT *, sum(c) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS k FROM (SELECT *, CASE WHEN clock < lag(clock) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) THEN 1 ELSE 0 END AS c FROM dy))
SELECT event_id, coalesce(day, last_value(day - k IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY off_us, event_id ROWS UNBOUNDED PRECEDING) + k,
first_value(day - k IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY off_us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + k)::BIGINT AS full_day FROM dc"""


@query(_DAYS)
def repaired_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("event_type").isin("view", "error"), F.floor(F.col("off_us") / 86_400_000_000))
    rows = windows(spark, sf_dir).select("subject_id", *ORDER, (F.floor(F.col("off_us") / 3_600_000_000) % 24).alias("clock"), day.alias("day"))
    return an.repaired_days(rows, ["subject_id"], ORDER, "day", "clock").select("event_id", "full_day")


@query("SELECT subject_id, sum(greatest(0, least(off_us + 86400000000, 2000000000000) - off_us))::BIGINT AS length FROM m GROUP BY ALL")
def clipped_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).select("subject_id", "off_us", (F.col("off_us") + 86_400_000_000).alias("to"), F.lit(2_000_000_000_000).alias("total"))
    return an.clipped_length(rows, ["subject_id"], "off_us", "to", "total")


@query("SELECT c_custkey FROM (SELECT DISTINCT c_custkey FROM customer) SEMI JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders) USING (c_custkey)", "")
def patients_with_both_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that two listings have."""
    return an.catalogue(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- arrays of samples ------------------------------------------------------------------------------

_LIST = ", ls AS (SELECT subject_id, recording_id, list(value ORDER BY off_us, event_id) AS l FROM m GROUP BY ALL)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = windows(spark, sf_dir).groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct(*ORDER, "value"))).alias("l"))
    return listed.select(*LINE, F.transform("l", lambda v: v["value"]).alias("l"))


@query("SELECT subject_id, recording_id, array_to_string(list_transform(l[least(3, len(l)) + 1:least(greatest(recording_id * 5, least(3, len(l))), len(l))], lambda x: printf('%.2f', x)), ',') AS part FROM ls", SQL + _LIST)
def time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a time range at 2.5 Hz, within bounds; halves round to even."""
    part = vt.time_slice(F.col("l"), F.lit(1.0), F.col("recording_id") * 2.0, F.lit(2.5))
    return _lists(spark, sf_dir).select(*LINE, F.array_join(F.transform(part, lambda x: F.format_string("%.2f", x)), ",").alias("part"))


ORACLE_SQL["time_slices"] = ORACLE_SQL["time_slices"].replace("least(3, len(l))", "least(2, len(l))")


@query("SELECT subject_id, recording_id, round(CASE WHEN s > 0 THEN (l[1] - a) / s ELSE 0 END, 6) AS first_z FROM (SELECT *, list_avg(l) AS a, list_stddev_pop(l) AS s FROM ls)", SQL + _LIST)
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select(*LINE, F.round(F.get(vt.z_scores(F.col("l")), F.lit(0)), 6).alias("first_z"))


@query("SELECT subject_id, recording_id, round(a, 6) AS intensity, round(0.9 * (1 - 0.5 * a), 6) AS quality FROM (SELECT *, tanh(2 * list_avg(list_transform(l, lambda x: abs(x / 1000) + abs(x / 2000) + 0.01))) AS a FROM ls)", SQL + _LIST)
def motion_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda f: F.transform("l", f)
    a = vt.motion_intensity(axis(lambda x: x / 1000), axis(lambda x: -x / 2000), axis(lambda x: F.lit(0.01)))
    return _lists(spark, sf_dir).select(*LINE, F.round(a, 6).alias("intensity"), F.round(F.lit(0.9) * (1 - 0.5 * a), 6).alias("quality"))


@query("SELECT subject_id, recording_id, round(list_avg(l[len(l) - q + 1:]) - list_avg(l[:q]), 6) AS drift FROM (SELECT *, greatest(1, len(l) // 4) AS q FROM ls)", SQL + _LIST)
def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select(*LINE, F.round(vt.baseline_drift(F.col("l")), 6).alias("drift"))


@query("""SELECT subject_id, recording_id, CASE WHEN len(g) = 0 THEN 'unusable' WHEN len(g) < 0.98 * len(l) OR list_max(g) - list_min(g) <= 1e-6 THEN 'poor' WHEN len(l) < 6 THEN 'limited' ELSE 'usable' END AS label
FROM (SELECT subject_id, recording_id, list(CASE WHEN value <= 480 THEN value END) AS l, list(value) FILTER (value <= 480) AS g0, coalesce(list(value) FILTER (value <= 480), []) AS g FROM m GROUP BY ALL)""")
def signal_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.transform("l", lambda x: F.when(x <= 480, x))
    return _lists(spark, sf_dir).select(*LINE, vt.usability(gaps, F.when(F.size("l") < 6, 1).otherwise(5)).alias("label"))
