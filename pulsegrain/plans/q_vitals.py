"""Vitals, rules and tracker queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.functions import vitals as vt
from pulsegrain.operators import rules as rl
from pulsegrain.operators import tracker as tr

from .testdata_model import ORDER, SQL, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KEYS = ["subject_id", "recording_id"]


def query(sql: str | None, prefix: str = SQL):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = prefix + sql
        return function

    return register


_RR = "CASE WHEN subject_id % 2 = 0 THEN rr_reg ELSE rr_ms END"
#: One row per interval with the one before and after it and its difference.
_SERIES = f""", i AS (SELECT subject_id, recording_id, {_RR} AS x, lag({_RR}) OVER w AS p, lead({_RR}) OVER w AS q, {_RR} - lag({_RR}) OVER w AS d FROM m WINDOW w AS (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id)),
g AS (SELECT subject_id, recording_id, count(*) AS n, avg(x) AS a, stddev_pop(x) AS s0, stddev_samp(x) AS s1, avg(d * d) AS dd, count(d) AS nd, count(*) FILTER (abs(d) > 50) AS n50, min(d) AS lo, max(d) AS hi, stddev_samp(d) AS sd,
count(*) FILTER ((x > p AND x > q) OR (x < p AND x < q)) AS tp, min(x) AS mn FROM i GROUP BY ALL),
b AS (SELECT subject_id, recording_id, count(*) AS c, any_value(nd) AS nd FROM (SELECT i.subject_id, i.recording_id, g.nd, least(floor((d - lo) / (hi - lo) * 16), 15) AS k FROM i JOIN g USING (subject_id, recording_id) WHERE d IS NOT NULL AND hi - lo >= 1e-6) GROUP BY subject_id, recording_id, k),
h AS (SELECT subject_id, recording_id, -sum((c / nd) * log2(c / nd)) / 4 AS e FROM b GROUP BY ALL),
z AS (SELECT g.*, CASE WHEN nd = 0 THEN NULL WHEN hi - lo < 1e-6 THEN 0.0 ELSE e END AS e, CASE WHEN n >= 3 THEN tp / (n - 2) END AS t, s0 / a AS cv FROM g LEFT JOIN h USING (subject_id, recording_id))"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = F.when(F.col("subject_id") % 2 == 0, F.col("rr_reg")).otherwise(F.col("rr_ms"))
    listed = windows(spark, sf_dir).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*ORDER, rr.alias("x")))).alias("l"))
    return listed.select(*KEYS, F.transform("l", lambda v: v["x"]).alias("rr"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("SELECT subject_id, recording_id, round(60000 / a, 6) AS hr, CASE WHEN n >= 3 THEN round(s1, 6) END AS sdnn, CASE WHEN n >= 3 THEN round(sqrt(dd), 6) END AS rmssd, round(100.0 * n50 / nullif(nd, 0), 6) AS pnn50 FROM g", SQL + _SERIES)
def hrv_time_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = F.col("rr")
    clean = _series(spark, sf_dir).withColumn("rr", vt.plausible(vt.finite(rr), 300, 2000))
    return _rounded(clean.select(*KEYS, vt.heart_rate(rr).alias("hr"), vt.sdnn(rr).alias("sdnn"), vt.rmssd(rr).alias("rmssd"), vt.pnn50(rr).alias("pnn50")), "hr", "sdnn", "rmssd", "pnn50")


@query("SELECT subject_id, recording_id, round(cv, 6) AS cv_population, round(s1 / a, 6) AS cv_sample FROM z", SQL + _SERIES)
def rr_irregularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _series(spark, sf_dir).select(*KEYS, vt.variation(F.col("rr")).alias("cv_population"), vt.variation(F.col("rr"), 1).alias("cv_sample"))
    return _rounded(found, "cv_population", "cv_sample")


@query("SELECT subject_id, recording_id, round(t, 6) AS turning_points FROM z", SQL + _SERIES)
def turning_point_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_series(spark, sf_dir).select(*KEYS, vt.turning_points(F.col("rr")).alias("turning_points")), "turning_points")


@query("SELECT subject_id, recording_id, round(e, 6) AS entropy FROM z", SQL + _SERIES)
def delta_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_series(spark, sf_dir).select(*KEYS, vt.delta_entropy(F.col("rr")).alias("entropy")), "entropy")


@query("SELECT subject_id, recording_id, CASE WHEN n < 5 THEN 'Unknown' WHEN cv > 0.06 AND e > 0.5 AND t BETWEEN 0.45 AND 0.80 THEN 'AF' WHEN cv < 0.05 THEN 'N' ELSE 'Other' END AS rhythm FROM z", SQL + _SERIES)
def rhythm_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select(*KEYS, vt.classify_rhythm(F.col("rr")).alias("rhythm"))


@query("SELECT subject_id, recording_id, round(sd / sqrt(2), 6) AS sd1, round(sqrt(greatest(0, 2 * s1 * s1 - sd * sd / 2)), 6) AS sd2 FROM g WHERE n >= 3", SQL + _SERIES)
def poincare_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _series(spark, sf_dir).where(F.size("rr") >= 3).select(*KEYS, vt.poincare(F.col("rr")).alias("p"))
    return _rounded(found.select(*KEYS, "p.sd1", "p.sd2"), "sd1", "sd2")


@query("""SELECT subject_id, recording_id, round(60000 / mn, 6) AS peak_rate, CASE WHEN 60000 / a < 60 THEN 'bradycardia' WHEN 60000 / a > 100 THEN 'tachycardia' ELSE 'normal' END AS assessment,
CASE WHEN a < 600 THEN 'below_normal' WHEN a > 1000 THEN 'above_normal' ELSE 'normal' END AS rr_assessment,
CASE WHEN 60000 / a < 60 THEN 'low' WHEN 60000 / a > 100 THEN 'high' ELSE 'normal' END AS category FROM g""", SQL + _SERIES)
def heart_rate_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    hr, rr = vt.heart_rate(F.col("rr")), vt.mean(F.col("rr"))
    return _series(spark, sf_dir).select(*KEYS, F.round(vt.peak_instant_rate(F.col("rr")), 6).alias("peak_rate"), vt.hr_assessment(hr).alias("assessment"), vt.rr_category(rr).alias("rr_assessment"), vt.hr_category(hr).alias("category"))


@query("""SELECT subject_id, recording_id, CASE WHEN q < 0.6 THEN FALSE ELSE (cv >= 0.18)::INT + (100.0 * n50 / nd >= 35)::INT + (sqrt(dd) >= 120)::INT >= 2 END AS irregular
FROM (SELECT *, (subject_id % 10) / 10.0 AS q FROM z) WHERE nd >= 2""", SQL + _SERIES)
def pulse_irregularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = F.col("rr")
    votes = vt.pulse_irregular(vt.variation(rr), vt.pnn50(rr), vt.rmssd(rr), (F.col("subject_id") % 10) / F.lit(10.0))
    return _series(spark, sf_dir).where(F.size("rr") >= 3).select(*KEYS, votes.alias("irregular"))


@query("""SELECT event_id, round(q, 6) AS quality, CASE WHEN q >= 0.8 THEN 'good' WHEN q >= 0.5 THEN 'acceptable' WHEN q IS NOT NULL THEN 'poor' END AS label FROM (SELECT event_id,
(0.4 * coalesce(a, 0) + 0.2 * coalesce(b, 0) + 0.15 * coalesce(c, 0)) / nullif(0.4 * (a IS NOT NULL)::INT + 0.2 * (b IS NOT NULL)::INT + 0.15 * (c IS NOT NULL)::INT, 0) AS q
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 500 END AS a, CASE WHEN event_type <> 'view' THEN 1 - value / 500 END AS b, CASE WHEN event_type = 'click' THEN 0.9 END AS c FROM m))""")
def quality_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    score = vt.weighted_quality([(F.when(kind != "error", value / 500), 0.4), (F.when(kind != "view", 1 - value / 500), 0.2), (F.when(kind == "click", F.lit(0.9)), 0.15)])
    return windows(spark, sf_dir).select("event_id", F.round(score, 6).alias("quality"), vt.quality_label(score).alias("label"))


@query("SELECT subject_id, recording_id, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, min(x) AS min, max(x) AS max, count(*) AS n FROM i GROUP BY ALL", SQL + _SERIES)
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rr = F.col("rr")
    return _series(spark, sf_dir).select(*KEYS, F.round(vt.mean(rr), 4).alias("mean"), F.round(vt.std(rr), 4).alias("std"), F.array_min(rr).alias("min"), F.array_max(rr).alias("max"), F.size(rr).cast("long").alias("n"))


@query("SELECT subject_id, recording_id, round((arg_max(value, window_index) - arg_min(value, window_index)) / nullif((max(off_us) - min(off_us)) / 1e6, 0), 9) AS slope FROM m GROUP BY ALL")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = windows(spark, sf_dir).groupBy(*KEYS).agg(F.min_by("value", "window_index").alias("a"), F.max_by("value", "window_index").alias("b"), ((F.max("off_us") - F.min("off_us")) / 1e6).alias("t"))
    return grouped.select(*KEYS, F.round(vt.slope(F.col("a"), F.col("b"), F.col("t")), 9).alias("slope"))


@query("""SELECT subject_id, recording_id, CASE WHEN s < 0.02 THEN 'low' WHEN s < 0.08 THEN 'medium' ELSE 'high' END AS motion
FROM (SELECT subject_id, recording_id, stddev_pop(sqrt(x * x / 4e7 + x * x / 1e8 + 0.01)) AS s FROM i GROUP BY ALL)""", SQL + _SERIES)
def motion_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda f: F.transform("rr", f)
    found = vt.motion_level(axis(lambda x: x / F.sqrt(F.lit(4e7))), axis(lambda x: x / F.lit(1e4)), axis(lambda x: F.lit(0.1)))
    return _series(spark, sf_dir).select(*KEYS, found.alias("motion"))


@query("SELECT subject_id, recording_id, round(s0 / nullif(stddev, 0), 6) AS snr FROM (SELECT g.*, (SELECT stddev_pop(d) FROM i WHERE i.subject_id = g.subject_id AND i.recording_id = g.recording_id) AS stddev FROM g)", SQL + _SERIES)
def snr_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_series(spark, sf_dir).select(*KEYS, vt.snr_proxy(F.col("rr")).alias("snr")), "snr")


@query("""SELECT subject_id, list_transform(list_slice(list_filter(list_transform(range(0, len(l)), lambda k: CASE WHEN k % (ceil(len(l) / 8.0)::BIGINT) = 0 THEN round(l[k + 1], 6) END), lambda x: x IS NOT NULL), 1, 8), lambda x: printf('%.3f', x))::VARCHAR AS preview
FROM (SELECT subject_id, list(rr_ms ORDER BY off_us, event_id) AS l FROM m GROUP BY ALL)""")
def preview_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = windows(spark, sf_dir).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "rr_ms"))).alias("l")).select("subject_id", F.transform("l", lambda v: v["rr_ms"]).alias("l"))
    text = F.transform(vt.decimate(F.col("l"), 8), lambda x: F.format_string("%.3f", x))
    return listed.select("subject_id", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("preview"))


# --- rules and tracker -----------------------------------------------------------------------

_TRACK = """, t AS (SELECT *, dur_us / 1e6 AS window_s, count(*) OVER f AS tachy_samples, CASE WHEN count(hr_bpm) OVER f > 0 THEN avg(CASE WHEN hr_bpm > 100 THEN 1.0 ELSE 0.0 END) OVER f END AS tachy_ratio
FROM m WINDOW f AS (PARTITION BY subject_id ORDER BY off_us, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, sum(CASE WHEN rhythm_class = 'AF' THEN dur_us END) OVER (PARTITION BY subject_id, g ORDER BY off_us, event_id) / 1e6 AS af_episode_s
FROM (SELECT *, sum(CASE WHEN rhythm_class IN ('N', 'Other') THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS g FROM t)),
f AS (SELECT *, coalesce(hr_bpm < 30 AND window_s >= 10, FALSE) AS r1, coalesce(hr_bpm > 200 AND window_s >= 10, FALSE) AS r2, coalesce(tachy_samples >= 30 AND tachy_ratio >= 0.8, FALSE) AS r3, coalesce(af_episode_s >= 86400, FALSE) AS r4 FROM u),
x AS (SELECT *, concat_ws(',', CASE WHEN r1 THEN 'extreme_bradycardia' END, CASE WHEN r2 THEN 'extreme_tachycardia' END, CASE WHEN r3 THEN 'sustained_tachycardia' END, CASE WHEN r4 THEN 'long_af_episode' END) AS rules,
CASE WHEN r1 OR r2 THEN 'critical' WHEN r4 THEN 'high' WHEN r3 THEN 'medium' ELSE 'none' END AS urgency FROM f)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.evaluate(tr.track(windows(spark, sf_dir), ["subject_id"], ORDER), rl.rules_for("ecg", staged=True))


@query("SELECT event_id, rules, urgency FROM x WHERE rules <> ''", SQL + _TRACK)
def rules_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).where(F.size("triggered") > 0).select("event_id", F.array_join("triggered", ",").alias("rules"), "urgency")


@query("""SELECT event_id, concat_ws(',', nullif(rules, ''), CASE WHEN event_type = 'error' AND position('sustained_tachycardia' IN rules) = 0 THEN 'sustained_tachycardia' END) AS rules,
CASE WHEN urgency = 'critical' THEN 'critical' WHEN event_type = 'error' OR urgency = 'high' THEN 'high' ELSE urgency END AS urgency FROM x""", SQL + _TRACK)
def rules_merged_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule layer's outcome merged with a second judge that calls every error row high."""
    judged = _evaluated(spark, sf_dir)
    error = F.col("event_type") == "error"
    ids = F.when(error, F.array(F.lit("sustained_tachycardia"))).otherwise(F.array().cast("array<string>"))
    both, urgency = rl.merge(F.col("triggered"), F.col("urgency"), ids, F.when(error, "high").otherwise("none"))
    return judged.select("event_id", F.array_join(both, ",").alias("rules"), urgency.alias("urgency"))


@query("""SELECT event_id, rules FROM (SELECT *, lag(rules) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS before FROM x) WHERE rules <> '' AND coalesce(before, '') <> rules""", SQL + _TRACK)
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.alerts(_evaluated(spark, sf_dir), ["subject_id"], ORDER).select("event_id", F.array_join("triggered", ",").alias("rules"))


@query("SELECT event_id FROM t WHERE coalesce(hr_bpm < 50 OR hr_bpm > 100, FALSE) OR coalesce(rhythm_class <> 'N', FALSE) OR value % 2 < 1 OR coalesce(tachy_ratio >= 0.5, FALSE)", SQL + _TRACK)
def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.track(windows(spark, sf_dir), ["subject_id"], ORDER)
    return rows.where(rl.judge_gate(F.col("hr_bpm"), F.col("rhythm_class"), F.col("value") % 2 < 1, F.col("tachy_ratio"))).select("event_id")


@query("SELECT subject_id, rule_id, min(off_us) AS first_at, count(*) AS rows FROM (SELECT subject_id, off_us, unnest(string_split(rules, ',')) AS rule_id FROM x WHERE rules <> '') GROUP BY ALL", SQL + _TRACK)
def first_rule_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.first_triggers(_evaluated(spark, sf_dir), ["subject_id"], "off_us")


_RUNS = """, k AS (SELECT *, CASE WHEN lag(rhythm_class) OVER w IS DISTINCT FROM rhythm_class OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS run FROM k),
l AS (SELECT subject_id, rhythm_class, sum(c) AS n, max(c) AS longest FROM (SELECT subject_id, rhythm_class, run, count(*) AS c FROM r WHERE rhythm_class IS NOT NULL GROUP BY ALL) GROUP BY ALL),
y AS (SELECT subject_id, sum(n)::BIGINT AS known, max_by(rhythm_class, (n, CASE rhythm_class WHEN 'AF' THEN 3 WHEN 'N' THEN 2 ELSE 1 END)) AS dominant, max(n)::BIGINT AS dominant_n, max(longest) FILTER (rhythm_class = 'AF') AS longest_af,
list_sort(list(rhythm_class) FILTER (longest >= 3)) AS sus FROM l GROUP BY ALL)"""


@query("""SELECT subject_id, known, dominant, dominant_n, longest_af, array_to_string(coalesce(sus, []), ',') AS sustained,
CASE WHEN list_contains(coalesce(sus, []), 'N') AND list_has_any(coalesce(sus, []), ['AF', 'Other']) THEN 'frequent_changes' WHEN len(coalesce(sus, [])) > 0 THEN 'stable' WHEN dominant_n / known >= 0.5 THEN 'stable' ELSE 'occasional_changes' END AS stability FROM y""", SQL + _RUNS)
def rhythm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tr.rhythm_summary(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class")
    label = vt.stability(F.col("sustained"), F.col("dominant_n") / F.col("known"), F.col("known"))
    return found.select("subject_id", "known", "dominant", "dominant_n", "longest_af", F.array_join("sustained", ",").alias("sustained"), label.alias("stability"))


@query("""SELECT y.subject_id, round(b.h / b.d, 9) AS af_burden, mx AS max_hr, b.n AS windows, tc AS transitions, coalesce(cf, 0) AS confirmed, coalesce(cd, 0)::BIGINT AS confirmed_duration
FROM (SELECT DISTINCT subject_id FROM m) y JOIN (SELECT subject_id, sum(CASE WHEN rhythm_class = 'AF' THEN dur_us ELSE 0 END)::DOUBLE AS h, sum(dur_us)::DOUBLE AS d, max(hr_bpm) AS mx, count(*) AS n FROM m GROUP BY 1) b USING (subject_id)
LEFT JOIN (SELECT subject_id, count(*) FILTER (p <> rhythm_class) AS tc FROM (SELECT *, lag(rhythm_class) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS p FROM m WHERE rhythm_class IS NOT NULL) GROUP BY 1) c USING (subject_id)
LEFT JOIN (SELECT subject_id, count(*) FILTER (c >= 2) AS cf, sum(d) FILTER (c >= 2) AS cd FROM (SELECT subject_id, run, count(*) AS c, sum(dur_us) AS d FROM r WHERE rhythm_class = 'AF' GROUP BY ALL) GROUP BY 1) e USING (subject_id)""", SQL + _RUNS)
def monitoring_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tr.summarise(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", "dur_us", "hr_bpm", 2)
    return found.select("subject_id", F.round("af_burden", 9).alias("af_burden"), "max_hr", "windows", "transitions", "confirmed", "confirmed_duration")


@query("""SELECT subject_id, CASE WHEN max(r) = 30 THEN round(avg(value) FILTER (r <= 10), 6) END AS recent, CASE WHEN max(r) = 30 THEN round(avg(value) FILTER (r > 10), 6) END AS before
FROM (SELECT subject_id, value, row_number() OVER (PARTITION BY subject_id ORDER BY off_us DESC, event_id DESC) AS r FROM m) WHERE r <= 30 GROUP BY ALL""")
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tr.period_comparison(windows(spark, sf_dir), ["subject_id"], ORDER, "value", 10, 20), "recent", "before")


@query("SELECT * FROM (VALUES ('extreme_bradycardia', 'critical', 'active'), ('extreme_tachycardia', 'critical', 'active'), ('sustained_tachycardia', 'medium', 'active'), ('long_af_episode', 'high', 'staged')) v(rule_id, urgency, phase)", "")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a, b, d) for a, b, _, d in rl.catalogue()], "rule_id string, urgency string, phase string")
