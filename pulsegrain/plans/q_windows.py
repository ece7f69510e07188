"""Windowing and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrain.operators import intervals as iv
from pulsegrain.operators import windowing as wn

from .testdata_model import DAY_US, ORDER, SQL, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
HOUR = DAY_US // 24
EXTENT = 30 * DAY_US


def query(sql: str | None, prefix: str = SQL):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = prefix + sql
        return function

    return register


@query(f"SELECT subject_id, off_us // {DAY_US} AS window, count(*) AS n, round(avg(hr_bpm), 6) AS mean_hr FROM m WHERE (off_us // {DAY_US} + 1) * {DAY_US} <= {EXTENT} GROUP BY ALL")
def tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.tumbling(windows(spark, sf_dir), ["subject_id"], "off_us", DAY_US, [F.count(F.lit(1)).alias("n"), F.round(F.avg("hr_bpm"), 6).alias("mean_hr")], EXTENT)


@query(f"""SELECT subject_id, w * {DAY_US // 2} AS window_start, count(*) AS n, max(hr_bpm) AS max_hr
FROM m, range(0, 64) g(w) WHERE off_us >= w * {DAY_US // 2} AND off_us < w * {DAY_US // 2} + {2 * DAY_US} AND w * {DAY_US // 2} + {2 * DAY_US} <= {EXTENT} GROUP BY ALL""")
def sliding_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.sliding(windows(spark, sf_dir), ["subject_id"], "off_us", 2 * DAY_US, DAY_US // 2, [F.count(F.lit(1)).alias("n"), F.max("hr_bpm").alias("max_hr")], EXTENT)


@query(f"SELECT subject_id, unnest(range(a, b - {7 * DAY_US} + 1, {2 * DAY_US})) AS window_start FROM (SELECT subject_id, min(off_us) AS a, max(off_us) AS b FROM m GROUP BY 1)")
def grid_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = windows(spark, sf_dir).groupBy("subject_id").agg(F.min("off_us").alias("a"), F.max("off_us").alias("b"))
    return wn.grid(bounds, "a", "b", 7 * DAY_US, 2 * DAY_US).select("subject_id", "window_start")


@query(f"SELECT subject_id, off_us // {DAY_US} AS window, round(count(*) / 1440.0, 9) AS rate FROM m GROUP BY ALL")
def hr_from_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wn.tumbling(windows(spark, sf_dir), ["subject_id"], "off_us", DAY_US, [F.count(F.lit(1)).alias("n")])
    return found.select("subject_id", "window", F.round(wn.rate_per_minute(F.col("n"), F.lit(DAY_US)), 9).alias("rate"))


_PEAK = f"""SELECT subject_id, w AS window, round(max(rate), 9) AS peak, round(min(rate) FILTER (d = {7 * HOUR}), 9) AS least_complete FROM (
SELECT subject_id, w, s, count(*) / (d / 60000000.0) AS rate, d FROM (SELECT subject_id, w, s, least(w * {DAY_US} + (s + 1) * {7 * HOUR}, (w + 1) * {DAY_US}, {29 * DAY_US + 3 * HOUR}) - (w * {DAY_US} + s * {7 * HOUR}) AS d
FROM (SELECT subject_id, off_us // {DAY_US} AS w, (off_us % {DAY_US}) // {7 * HOUR} AS s FROM m WHERE off_us < {29 * DAY_US + 3 * HOUR})) GROUP BY subject_id, w, s, d) GROUP BY ALL"""


@query(_PEAK)
def max_hr_subwindow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest rate over sub-windows with partial ones, and lowest over complete ones."""
    found = wn.peak_rate(windows(spark, sf_dir), ["subject_id"], "off_us", DAY_US, 7 * HOUR, 29 * DAY_US + 3 * HOUR)
    return found.withColumns({c: F.round(c, 9) for c in ("peak", "least_complete")})


@query(f"""SELECT subject_id, session, count(*) AS n, min(off_us) AS start_us, max(off_us) AS end_us FROM (SELECT *, sum(o) OVER (PARTITION BY subject_id ORDER BY off_us, event_id)::BIGINT AS session
FROM (SELECT *, CASE WHEN off_us - lag(off_us) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) <= {2 * HOUR} THEN 0 ELSE 1 END AS o FROM m)) GROUP BY ALL""")
def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wn.sessions(windows(spark, sf_dir), ["subject_id"], ORDER, "off_us", 2 * HOUR)
    return found.groupBy("subject_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("off_us").alias("start_us"), F.max("off_us").alias("end_us"))


@query('SELECT subject_id, g AS "group", round(avg(hr_bpm), 6) AS mean FROM (SELECT *, (row_number() OVER (PARTITION BY subject_id ORDER BY off_us, event_id) - 1) // 3 AS g FROM m) GROUP BY ALL HAVING count(*) = 3')
def hr_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.complete_groups(windows(spark, sf_dir), ["subject_id"], ORDER, "hr_bpm", 3).withColumn("mean", F.round("mean", 6))


@query("""SELECT subject_id, recording_id, sum(st) OVER (PARTITION BY subject_id ORDER BY recording_id)::BIGINT AS offset_us
FROM (SELECT *, greatest(0, coalesce(s - lag(s) OVER w, lag(d) OVER w, 0)) AS st
FROM (SELECT subject_id, recording_id, CASE WHEN recording_id <> 2 THEN min(off_us) END AS s, max(off_us) - min(off_us) AS d FROM m GROUP BY subject_id, recording_id) WINDOW w AS (PARTITION BY subject_id ORDER BY recording_id))""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = windows(spark, sf_dir).groupBy("subject_id", "recording_id").agg(F.min("off_us").alias("s"), (F.max("off_us") - F.min("off_us")).alias("d"))
    segments = segments.withColumn("s", F.when(F.col("recording_id") != 2, F.col("s")))
    return wn.cumulative_offsets(segments, ["subject_id"], ["recording_id"], "s", "d").select("subject_id", "recording_id", F.col("offset").alias("offset_us"))


_STEPS = """, st AS (SELECT *, lead(off_us) OVER w - off_us AS step FROM m WINDOW w AS (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id)),
la AS (SELECT subject_id, recording_id, arg_max(step, off_us) FILTER (step > 0) AS last_step FROM st GROUP BY ALL)
SELECT event_id, coalesce(CASE WHEN step > 0 THEN step END, last_step, 0) AS filled FROM st JOIN la USING (subject_id, recording_id)"""


@query(_STEPS)
def duration_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).withColumn("given", F.when(F.col("event_type") == "view", F.lit(None).cast("long")).otherwise(F.lit(0).cast("long")))
    return wn.inferred_durations(rows, ["subject_id", "recording_id"], ORDER, "off_us", "given").select("event_id", "filled")


# --- interval joins: the variable tiles are annotation spans, days are windows -------------------

_DAYS = f""", d AS (SELECT subject_id, w * {DAY_US} AS ws, (w + 1) * {DAY_US} AS we FROM (SELECT DISTINCT subject_id FROM m), range(0, 30) g(w)),
o AS (SELECT d.subject_id, ws, we, event_id, rhythm_class, greatest(ws, off_us) AS os, least(we, end_us) AS oe FROM d JOIN m ON d.subject_id = m.subject_id AND off_us < we AND end_us > ws)"""


def _days(rows: DataFrame) -> DataFrame:
    return rows.select("subject_id").distinct().withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("subject_id", (F.col("w") * F.lit(DAY_US)).alias("ws"), ((F.col("w") + 1) * F.lit(DAY_US)).alias("we"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    return iv.overlap_join(_days(rows), rows, ["subject_id"], ("ws", "we"), ("off_us", "end_us"), DAY_US)


@query("SELECT subject_id, ws, event_id, os AS overlap_start, oe AS overlap_end FROM o WHERE oe > os", SQL + _DAYS)
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("subject_id", "ws", "event_id", "overlap_start", "overlap_end")


@query(f"""SELECT subject_id, ws, max_by(rhythm_class, (t, CASE rhythm_class WHEN 'AF' THEN 3 WHEN 'Other' THEN 2 ELSE 1 END)) AS dominant, max(t)::BIGINT AS dominant_total
FROM (SELECT subject_id, ws, rhythm_class, sum(oe - os) AS t FROM o WHERE oe - os >= {HOUR} AND rhythm_class IS NOT NULL GROUP BY ALL) GROUP BY ALL""", SQL + _DAYS)
def dominant_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.best_label(_overlaps(spark, sf_dir), ["subject_id", "ws"], "rhythm_class", {"AF": 3, "Other": 2, "N": 1}, HOUR)


_BURDEN = f"""SELECT subject_id, ws, round(CASE WHEN k > 0 THEN h / k END, 9) AS annotated_burden, round(h / {DAY_US}.0, 9) AS window_burden, round(k / {DAY_US}.0, 9) AS coverage, k >= {DAY_US} AS fully_covered
FROM (SELECT subject_id, ws, coalesce(sum(CASE WHEN rhythm_class = 'AF' THEN oe - os END), 0)::DOUBLE AS h, coalesce(sum(CASE WHEN rhythm_class IS NOT NULL THEN oe - os END), 0)::DOUBLE AS k FROM o WHERE oe > os GROUP BY ALL)"""


def _burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.burden(_overlaps(spark, sf_dir), ["subject_id", "ws"], "rhythm_class", "AF", F.lit(DAY_US))


@query(_BURDEN, SQL + _DAYS)
def af_burden_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AF burden with both denominators, annotation coverage and full coverage."""
    return _burden(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("annotated_burden", "window_burden", "coverage")})


@query(f"""SELECT subject_id, ws, CASE WHEN NOT fully_covered OR window_burden IS NULL THEN 'unlabeled' WHEN window_burden <= 0.05 + 1e-9 THEN 'NSR' WHEN window_burden >= 0.80 - 1e-9 THEN 'AF' ELSE 'transition' END AS label,
CASE WHEN annotated_burden IS NULL OR abs(annotated_burden - 0.5) < 0.1 THEN NULL WHEN annotated_burden >= 0.5 THEN 'AF' ELSE 'N' END AS rhythm FROM ({_BURDEN})""", SQL + _DAYS)
def window_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _burden(spark, sf_dir)
    return found.select("subject_id", "ws", iv.window_label(F.col("window_burden"), F.col("fully_covered")).alias("label"), iv.burden_rhythm(F.col("annotated_burden"), 0.5, 0.1).alias("rhythm"))


@query(f"SELECT subject_id, ws FROM ({_BURDEN}) WHERE coverage >= 0.8", SQL + _DAYS)
def annotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _burden(spark, sf_dir).where("coverage >= 0.8").select("subject_id", "ws")


@query(f"SELECT d.subject_id, ws, count(*) AS beats FROM d JOIN m ON d.subject_id = m.subject_id AND off_us >= ws AND off_us < we GROUP BY ALL", SQL + _DAYS)
def beats_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    return iv.contained_points(rows, _days(rows), ["subject_id"], "off_us", ("ws", "we"), DAY_US).groupBy("subject_id", "ws").agg(F.count(F.lit(1)).alias("beats"))


@query(f"SELECT subject_id, ws, list_sort(list(off_us - ws))::VARCHAR AS beats FROM (SELECT d.subject_id, ws, off_us FROM d JOIN m ON d.subject_id = m.subject_id AND off_us >= ws AND off_us < we WHERE ws < {3 * DAY_US}) GROUP BY ALL", SQL + _DAYS)
def window_annotation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats re-based to their window."""
    rows = windows(spark, sf_dir)
    found = iv.contained_points(rows, _days(rows).where(F.col("ws") < 3 * DAY_US), ["subject_id"], "off_us", ("ws", "we"), DAY_US)
    listed = found.groupBy("subject_id", "ws").agg(F.array_sort(F.collect_list(F.col("off_us") - F.col("ws"))).alias("b"))
    return listed.select("subject_id", "ws", F.concat(F.lit("["), F.concat_ws(", ", F.col("b").cast("array<string>")), F.lit("]")).alias("beats"))


@query("""SELECT subject_id, recording_id, arg_min(k, (-c, k)) AS mode, max(c) AS mode_count, sum(c)::BIGINT AS total, round(max(c) / sum(c), 9) AS fraction
FROM (SELECT subject_id, recording_id, CAST(value AS BIGINT) // 100 AS k, count(*) AS c FROM (SELECT subject_id, recording_id, floor(value) AS value FROM m) GROUP BY ALL) GROUP BY ALL""")
def mode_smallest_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).withColumn("k", F.floor(F.floor("value") / 100))
    return iv.mode_smallest(rows, ["subject_id", "recording_id"], "k").withColumn("fraction", F.round("fraction", 9))


_PAIR = f""", a AS (SELECT subject_id, recording_id, min(off_us) AS s, max(off_us) AS e FROM m GROUP BY ALL),
b AS (SELECT subject_id, off_us // {10 * DAY_US} AS chunk, min(off_us) AS cs, max(off_us) AS ce FROM m GROUP BY ALL)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = windows(spark, sf_dir)
    a = rows.groupBy("subject_id", "recording_id").agg(F.min("off_us").alias("s"), F.max("off_us").alias("e"))
    b = rows.groupBy("subject_id", F.floor(F.col("off_us") / (10 * DAY_US)).alias("chunk")).agg(F.min("off_us").alias("cs"), F.max("off_us").alias("ce"))
    return a, b


@query("SELECT subject_id, recording_id, chunk, greatest(s, cs) AS overlap_start, least(e, ce) AS overlap_end FROM a JOIN b USING (subject_id) WHERE s < ce AND e > cs", SQL + _PAIR)
def simultaneous_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    return iv.overlap_join(a, b, ["subject_id"], ("s", "e"), ("cs", "ce"), 7 * DAY_US).select("subject_id", "recording_id", "chunk", "overlap_start", "overlap_end")


@query("""SELECT subject_id, recording_id, bool_or(s < ce AND e > cs) AS any_overlap, bool_and(s >= cs AND e <= ce) AS all_inside, count(*) FILTER (s < ce AND e > cs) AS n_overlap
FROM a JOIN b USING (subject_id) GROUP BY ALL""", SQL + _PAIR)
def alignment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    return iv.alignment(a.join(b, "subject_id"), ["subject_id", "recording_id"], ("s", "e"), ("cs", "ce"))


@query("SELECT subject_id, (max(end_us) - min(off_us))::BIGINT AS covered FROM m WHERE end_us IS NOT NULL GROUP BY ALL")
def union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_length(windows(spark, sf_dir).where("end_us IS NOT NULL"), ["subject_id"], "off_us", "end_us")


@query("SELECT count(*) AS n, count(DISTINCT subject_id) AS subjects FROM m WHERE end_us - off_us > 0")
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).where("end_us - off_us > 0").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject_id").alias("subjects"))


@query("SELECT event_id, row_number() OVER (PARTITION BY subject_id ORDER BY recording_id, off_us, event_id) - 1 AS global_index FROM m")
def global_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject_id").orderBy("recording_id", *ORDER)
    return windows(spark, sf_dir).select("event_id", (F.row_number().over(w) - 1).alias("global_index"))
