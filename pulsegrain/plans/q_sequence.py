"""Sequence queries: transitions, runs, debouncing, episodes, timers and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.operators import sequence as seq

from .q_state import LINE
from .testdata_model import ORDER, SQL, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_W = "(PARTITION BY subject_id ORDER BY off_us, event_id)"
_RUNS = f""", k AS (SELECT *, row_number() OVER {_W} AS n, CASE WHEN lag(rhythm_class) OVER {_W} IS DISTINCT FROM rhythm_class OR row_number() OVER {_W} = 1 THEN 1 ELSE 0 END AS s FROM m),
r AS (SELECT *, sum(s) OVER {_W} AS run FROM k)"""


def query(sql: str | None, prefix: str = ""):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = SQL + prefix + sql
        return function

    return register


@query(f"""SELECT event_id, f AS from_label, rhythm_class AS to_label FROM (SELECT *, lag(rhythm_class) OVER {_W} AS f FROM m) WHERE f <> rhythm_class""")
def transitions_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.changes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", bridge=False).select("event_id", "from_label", "to_label")


@query(f"""SELECT event_id, f AS from_label, rhythm_class AS to_label FROM (SELECT *, lag(rhythm_class) OVER {_W} AS f FROM m WHERE rhythm_class IS NOT NULL) WHERE f <> rhythm_class""")
def transitions_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.changes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class").select("event_id", "from_label", "to_label")


@query(f"""SELECT subject_id, recording_id, count(*) FILTER (rhythm_class IS NULL OR f IS NULL) AS skipped_pairs, count(*) FILTER (f <> rhythm_class) AS transitions
FROM (SELECT *, lag(rhythm_class) OVER w AS f, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id)) WHERE n > 1 GROUP BY ALL""")
def transitions_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.skipped_pairs(windows(spark, sf_dir), LINE, ORDER, "rhythm_class")


_DEBOUNCE = f""", kn AS (SELECT *, row_number() OVER {_W} AS n FROM m WHERE rhythm_class IS NOT NULL),
ks AS (SELECT *, CASE WHEN n = 1 OR lag(rhythm_class) OVER {_W} <> rhythm_class THEN 1 ELSE 0 END AS s FROM kn),
kr AS (SELECT *, sum(s) OVER {_W} AS run FROM ks),
kc AS (SELECT subject_id, run, any_value(rhythm_class) AS to_label, min(n) AS f, count(*) AS c, min_by(event_id, n) AS event_id, min_by(off_us, n) AS off_us FROM kr GROUP BY ALL HAVING count(*) >= 3 OR min(n) = 1),
kl AS (SELECT *, lag(to_label) OVER (PARTITION BY subject_id ORDER BY f) AS from_label FROM kc)
SELECT subject_id, event_id, off_us, from_label, to_label FROM kl WHERE from_label <> to_label AND c >= 3"""


@query(_DEBOUNCE)
def transitions_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.debounced(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", 3).select("subject_id", "event_id", "off_us", "from_label", "to_label")


@query("""SELECT subject_id, rhythm_class, min(off_us) AS run_start, max(end_us) AS run_end, count(*) AS run_rows,
row_number() OVER (PARTITION BY subject_id ORDER BY run) - 1 AS episode FROM r WHERE rhythm_class IN ('AF', 'Other') GROUP BY subject_id, run, rhythm_class""", _RUNS)
def abnormal_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.episodes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", ["AF", "Other"], "off_us", "end_us")
    return found.withColumn("episode", F.col("episode").cast("long"))


@query("SELECT subject_id, rhythm_class, max(c) AS longest FROM (SELECT subject_id, run, rhythm_class, count(*) AS c FROM r WHERE rhythm_class IS NOT NULL GROUP BY ALL) GROUP BY ALL", _RUNS)
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.longest_runs(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class")


@query("""SELECT subject_id, count(*) FILTER (c >= 3) AS confirmed, coalesce(sum(d) FILTER (c >= 3), 0)::BIGINT AS confirmed_duration
FROM (SELECT subject_id, run, count(*) AS c, sum(dur_us) AS d FROM r WHERE rhythm_class = 'AF' GROUP BY ALL) GROUP BY ALL""", _RUNS)
def confirmed_af(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.confirmed_episodes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", "AF", 3, "dur_us")


@query("SELECT subject_id, run, rhythm_class, min(off_us) AS seg_start, max(coalesce(end_us, off_us)) AS seg_end FROM r GROUP BY ALL", _RUNS)
def rhythm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.rhythm_segments(windows(spark, sf_dir), ["subject_id"], ORDER, "off_us", "rhythm_class")


_TOTAL = 31 * 86_400_000_000


@query(f"""SELECT subject_id, rhythm_class, b AS span_start, coalesce(least(lead(b) OVER w, {_TOTAL}), {_TOTAL}) AS span_end
FROM (SELECT *, CASE WHEN n = 1 THEN 0 ELSE off_us END AS b FROM r WHERE s = 1) WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)""", _RUNS)
def change_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.change_markers(windows(spark, sf_dir), ["subject_id"], ORDER, "off_us", "rhythm_class", F.lit(_TOTAL)).select("subject_id", "rhythm_class", "span_start", "span_end")


@query(f"""SELECT subject_id, f AS from_label, rhythm_class AS to_label, count(*) AS n FROM (SELECT *, lag(rhythm_class) OVER {_W} AS f FROM m WHERE rhythm_class IS NOT NULL) WHERE f <> rhythm_class GROUP BY ALL""")
def transition_direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.changes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class").groupBy("subject_id", "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, round(avg(CASE WHEN hr_bpm > 100 THEN 1.0 ELSE 0.0 END) OVER f, 6) AS plain_ratio,
CASE WHEN count(hr_bpm) OVER f > 0 THEN round(avg(CASE WHEN hr_bpm > 100 THEN 1.0 ELSE 0.0 END) OVER f, 6) END AS ratio, count(*) OVER f AS samples
FROM m WINDOW f AS (PARTITION BY subject_id ORDER BY off_us, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""".replace("round(avg(CASE WHEN hr_bpm > 100 THEN 1.0 ELSE 0.0 END) OVER f, 6) AS plain_ratio,\n", ""))
def tachy_ratio_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.exceed_ratio(windows(spark, sf_dir), ["subject_id"], ORDER, "hr_bpm", 100, 30).select("event_id", F.round("ratio", 6).alias("ratio"), "samples")


@query(f"""SELECT event_id, sum(CASE WHEN rhythm_class = 'AF' THEN dur_us END) OVER (PARTITION BY subject_id, g ORDER BY off_us, event_id)::BIGINT AS timer
FROM (SELECT *, sum(CASE WHEN rhythm_class IN ('N', 'Other') THEN 1 ELSE 0 END) OVER {_W} AS g FROM m)""")
def af_episode_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.episode_timer(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", "dur_us").select("event_id", "timer")


@query(f"""SELECT event_id, last_value(a IGNORE NULLS) OVER v AS trailing_mean, last_value(b IGNORE NULLS) OVER v AS trailing_min, last_value(c IGNORE NULLS) OVER v AS trailing_max
FROM (SELECT m.subject_id, m.off_us, m.event_id, round(a, 10) AS a, b, c FROM m LEFT JOIN (SELECT event_id, avg(hr_bpm) OVER f AS a, min(hr_bpm) OVER f AS b, max(hr_bpm) OVER f AS c FROM m WHERE hr_bpm IS NOT NULL
WINDOW f AS (PARTITION BY subject_id ORDER BY off_us, event_id ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)) t ON m.event_id = t.event_id)
WINDOW v AS (PARTITION BY subject_id ORDER BY off_us, event_id)""")
def medium_hr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.trailing_stats(windows(spark, sf_dir), ["subject_id"], ORDER, "hr_bpm", 360)
    return found.select("event_id", F.round("trailing_mean", 10).alias("trailing_mean"), "trailing_min", "trailing_max")


@query(f"""SELECT event_id, n // 360 AS snapshot FROM (SELECT *, row_number() OVER {_W} - 1 AS n, count(*) OVER (PARTITION BY subject_id) AS t FROM m) WHERE n % 360 = 359 OR n = t - 1""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.snapshots(windows(spark, sf_dir), ["subject_id"], ORDER, 360).select("event_id", "snapshot")


@query(f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY off_us DESC, event_id DESC) AS n FROM m) WHERE n <= 20")
def trend_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.keep_last(windows(spark, sf_dir), ["subject_id"], ORDER, 20).select("event_id")


@query("SELECT event_id, (row_number() OVER (PARTITION BY subject_id, run ORDER BY off_us, event_id) - 1) % 5 = 0 AS fresh FROM r", _RUNS)
def judge_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.reuse_groups(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", 4).select("event_id", "fresh")


_EMA = """, o AS (SELECT subject_id, hr_bpm, row_number() OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS n FROM m WHERE hr_bpm IS NOT NULL),
f AS (SELECT subject_id, n, round(hr_bpm, 1) AS b FROM o WHERE n = 1 UNION ALL
SELECT o.subject_id, o.n, CASE WHEN abs(o.hr_bpm - f.b) >= 0.2 * f.b THEN f.b ELSE round(f.b + 0.05 * (o.hr_bpm - f.b), 1) END FROM f JOIN o ON o.subject_id = f.subject_id AND o.n = f.n + 1)
SELECT subject_id, arg_max(b, n) AS baseline, count(*) AS values FROM f GROUP BY subject_id"""


@query(_EMA.replace(", o AS", ", o AS", 1))
def resting_hr_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.ema_skip(windows(spark, sf_dir), ["subject_id"], ORDER, "hr_bpm")


ORACLE_SQL["resting_hr_ema"] = ORACLE_SQL["resting_hr_ema"].replace("WITH e0", "WITH RECURSIVE e0", 1)
