"""Queries over replays, live sessions, selections and signal kernels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.functions import morphology as mo
from pulsegrain.functions import signal as sg
from pulsegrain.functions import vitals as vt
from pulsegrain.operators import replay as rp
from pulsegrain.operators import rules as rl
from pulsegrain.operators import sequence as seq
from pulsegrain.runtime import shared_folder, ship
from pulsegrain.sources import recordings
from pulsegrain.streaming import tracker_stream as ts
from pulsegrain.streaming import windows_stream as ws

from . import q_stream
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


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Beats in a squeezed time, so that some sub-windows are full and some empty.
_SQUEEZED = ", bt AS (SELECT subject_id, off_us // 1000000000 AS tt FROM m), sw AS (SELECT subject_id, lo, hi, CASE WHEN subject_id % 4 = 0 THEN 5 WHEN subject_id % 4 = 1 THEN 95 ELSE 900 END AS d FROM (SELECT DISTINCT subject_id, 100 AS lo, 0 AS hi FROM m)), sg AS (SELECT subject_id, unnest(generate_series(0, least(d, 600) // 10 - 1)) AS k FROM sw WHERE d >= 10)"


def _subs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = windows(spark, sf_dir)
    k = F.col("subject_id") % 4
    asked = rows.select("subject_id").distinct().select("subject_id", F.lit(100).cast("bigint").alias("lo"), (100 + F.when(k == 0, 5).when(k == 1, 95).otherwise(900)).cast("bigint").alias("hi"))
    return rp.sub_windows(asked, ["subject_id"], "lo", "hi"), rows.select("subject_id", F.floor(F.col("off_us") / 1_000_000_000).alias("at"))


@query("SELECT subject_id, k AS sub_index, 100 + 10 * k AS sub_start FROM sg", SQL + _SQUEEZED)
def sub_window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-windows of ten seconds: under ten none, over 600 cut, a tail left out."""
    return _subs(spark, sf_dir)[0].select("subject_id", "sub_index", "sub_start")


@query("""SELECT subject_id, k AS sub_index, hr AS hr_bpm, concat_ws(',', CASE WHEN hr < 30 THEN 'extreme_bradycardia' END, CASE WHEN hr > 200 THEN 'extreme_tachycardia' END, CASE WHEN n30 >= 30 AND r30 >= 0.8 THEN 'sustained_tachycardia' END) AS rules
FROM (SELECT *, count(*) OVER f AS n30, avg(CASE WHEN hr > 100 THEN 1.0 ELSE 0.0 END) OVER f AS r30 FROM (SELECT sg.subject_id, k, count(*) * 6.0 AS hr FROM sg JOIN bt ON bt.subject_id = sg.subject_id AND bt.tt >= 100 + 10 * k AND bt.tt < 110 + 10 * k GROUP BY ALL) WINDOW f AS (PARTITION BY subject_id ORDER BY k ROWS 29 PRECEDING))""", SQL + _SQUEEZED)
def sub_window_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over sub-windows with beats; those without do not touch the tracker."""
    subs, beats = _subs(spark, sf_dir)
    found = rp.replay_rules(subs, beats, ["subject_id"], "at", 10, rl.rules_for("ecg"))
    return found.select("subject_id", "sub_index", "hr_bpm", F.array_join("triggered", ",").alias("rules"))


@query("""SELECT subject_id, recording_id, CASE WHEN recording_id * 604800 - 259200 >= 0 THEN (SELECT count(*) FROM m b WHERE b.subject_id = w.subject_id AND b.off_us // 1000000 >= w.recording_id * 604800 - 259200 AND b.off_us // 1000000 < w.recording_id * 604800) END AS previous_beats FROM (SELECT DISTINCT subject_id, recording_id FROM m) w""")
def previous_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of the three days before each week, counted from the raw beats."""
    rows = windows(spark, sf_dir)
    weeks = rows.select("subject_id", "recording_id").distinct().withColumns({"lo": F.col("recording_id") * 604_800, "hi": (F.col("recording_id") + 1) * 604_800, "zero": F.lit(0)})
    beats = rows.select("subject_id", F.floor(F.col("off_us") / 1_000_000).alias("at"))
    return rp.previous_from_raw(weeks, beats, ["subject_id"], "recording_id", ("lo", "hi"), "at", 259_200, "zero").select("subject_id", "recording_id", "previous_beats")


@query("""SELECT subject_id, arg_max(l, (d, -a)) AS truth FROM (SELECT subject_id, CASE event_type WHEN 'view' THEN 'N' WHEN 'click' THEN 'AF' WHEN 'error' THEN 'Unknown' ELSE 'Other' END AS l, sum(w) AS d, min(s) AS a FROM (SELECT subject_id, event_type, window_index AS s, 1 + window_index % 3 AS w FROM m) GROUP BY ALL) GROUP BY ALL""")
def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest label, the first seen of equal ones."""
    label = F.when(F.col("event_type") != "error", F.col("event_type"))
    spans = windows(spark, sf_dir).select("subject_id", label.alias("label"), F.col("window_index").alias("s"), (F.col("window_index") + 1 + F.col("window_index") % 3).alias("e"))
    return rp.truth_label(spans, ["subject_id"], "label", "s", "e", {"view": "N", "click": "AF"})


@query("SELECT event_id, CASE WHEN value > 100 THEN 'fast' ELSE 'slow' END AS rhythm_class, round(value * 2, 6) AS hr_bpm FROM events", "")
def replaced_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window analysis with other kernels than its own."""
    rr = F.array("value")
    found = rp.analysed(table(spark, sf_dir, "events"), rr, lambda x: F.get(x, F.lit(0)) * 2, lambda x: F.when(F.get(x, F.lit(0)) > 100, "fast").otherwise("slow"))
    return found.select("event_id", "rhythm_class", F.round("hr_bpm", 6).alias("hr_bpm"))


@query("SELECT event_id, 'p' || user_id AS patient_id, CASE WHEN event_id % 2 = 0 THEN 's1' ELSE 'w' END AS segment_id, event_id % 50 AS window_index, CASE WHEN event_type = 'click' THEN 'high' ELSE 'none' END AS urgency, CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS rules, event_type = 'view' AS condition_active FROM events", "")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of results: the window's fields where the result is silent, then defaults."""
    e, kind = F.col("event_id"), F.col("event_type")
    own = F.create_map(F.lit("segment_id"), F.when(e % 2 == 0, "s1"), F.lit("urgency"), F.when(kind == "click", "high"), F.lit("triggered_rules"), F.when(kind == "click", "a,b"), F.lit("condition_active"), F.when(kind == "view", "true"))
    window = F.create_map(F.lit("patient_id"), F.concat(F.lit("p"), "user_id"), F.lit("segment_id"), F.lit("w"), F.lit("window_index"), (e % 50).cast("string"))
    found = rp.event_records(table(spark, sf_dir, "events").select("event_id", own.alias("own"), window.alias("window")), "own", "window")
    return found.select("event_id", "patient_id", "segment_id", F.col("window_index").cast("bigint"), "urgency", F.size("triggered_rules").alias("rules"), "condition_active")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 30.0 WHEN 1 THEN 10.0 WHEN 2 THEN 5.0 END AS seconds FROM events", "")
def window_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duration from the first of three places that holds a positive one."""
    k = F.col("event_id") % 4
    found = rp.duration_of(F.when(k == 0, "30").when(k == 1, "-1").otherwise("x"), F.when(k == 1, F.lit(10.0)).otherwise(F.lit(0.0)), F.when(k.isin(1, 2), F.lit(5)))
    return table(spark, sf_dir, "events").select("event_id", found.alias("seconds"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN (epoch_us(ts) - 1704067200000000) / 1e6 ELSE 7.5 END AS start_s, CASE WHEN event_type = 'view' THEN (epoch_us(ts) - 1704067200000000) / 1e6 ELSE 7.5 END + 30 AS end_s FROM events", "")
def reference_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window bounds on another recording's clock."""
    start = F.when(F.col("event_type") == "view", F.col("ts").cast("timestamp"))
    bounds = rp.on_reference_clock(start, F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(7.5), F.lit(30.0))
    return table(spark, sf_dir, "events").select("event_id", bounds.alias("b")).select("event_id", "b.*")


@query("SELECT event_id FROM events WHERE user_id % 3 = 1", "")
def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.of_generation(table(spark, sf_dir, "events").withColumn("generation", F.col("user_id") % 3), "generation", 1).select("event_id")


@query("SELECT subject_id, arg_max(event_id, (off_us, event_id)) AS event_id FROM m WHERE off_us <= 1000000000000 GROUP BY ALL")
def session_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last window that a live session has shown at a cursor."""
    return rp.as_of_cursor(windows(spark, sf_dir), ["subject_id"], ORDER, "off_us", F.lit(1_000_000_000_000)).select("subject_id", "event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", "")
def replay_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream driven through a sink batch by batch, each batch once."""
    folder = _folder(spark, "driver")
    rp.replayed(spark, q_stream._events(spark, sf_dir).select("event_type", "value"), ws.replay_sink(f"{folder}/out"), f"{folder}/state")
    return spark.read.json(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT subject_id % 4 AS segment, count(*) AS n, max(off_us) AS last_at FROM m GROUP BY ALL")
def segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live source of several segment files, one a batch."""
    folder = _folder(spark, "segments")
    rows = windows(spark, sf_dir).select((F.col("subject_id") % 4).alias("segment"), "off_us")
    rows.repartition(4, "segment").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return ts.run_to_end(spark, stream, f"{folder}/done").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.max("off_us").alias("last_at"))


_PIPE = """, p AS (SELECT *, round(60000 / rr_reg, 9) AS hr FROM m)
SELECT event_id, count(*) OVER f AS samples, round(avg(CASE WHEN 60000 / rr_reg > 100 THEN 1.0 ELSE 0.0 END) OVER f, 6) AS ratio, CAST(NULL AS DOUBLE) AS timer FROM p WINDOW f AS (PARTITION BY subject_id ORDER BY off_us, event_id ROWS 29 PRECEDING)"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in, vitals and rhythm by expressions, then the keyed tracker with its rules."""
    rows = q_stream._events(spark, sf_dir).withColumn("rr", F.array_repeat(800 + F.col("value") / 10, 6))
    vitals = rp.analysed(rows, F.col("rr")).select(F.col("user_id").alias("subject_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)).alias("off_us"), "hr_bpm", "rhythm_class")
    return ts.run_to_end(spark, ts.track_stream(vitals), _folder(spark, "pipeline"))


@query(_PIPE)
def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline(spark, sf_dir).select("event_id", "samples", F.round("ratio", 6).alias("ratio"), "timer")


@query("SELECT subject_id, arg_max(event_id, (off_us, event_id)) AS event_id, least(count(*), 30) AS samples FROM m GROUP BY ALL")
def stream_state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each subject after the stream: its last row."""
    return seq.keep_last(_pipeline(spark, sf_dir), ["subject_id"], ORDER, 1).select("subject_id", "event_id", "samples")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('7:' || event_id)) AS n, sha256('7:' || event_id) AS h FROM events WHERE value > 20 AND upper(CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'B' END) = 'A') WHERE n <= 20 ORDER BY h LIMIT 50", "")
def evaluation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a tier in a seeded order, at most so many of each target, at most so many in all."""
    tier = F.when(F.col("user_id") % 2 == 0, "a").otherwise("B")
    rows = table(spark, sf_dir, "events").where((F.col("value") > 20) & (F.upper(tier) == "A"))
    order = F.sha2(F.concat(F.lit("7:"), "event_id"), 256)
    ranked = seq.keep_last(rows.withColumn("h", order).withColumn("back", F.translate("h", "0123456789abcdef", "fedcba9876543210")), ["event_type"], ["back"], 20)
    return ranked.orderBy("h").limit(50).select("event_id")


@query("SELECT event_id, user_id = 3 AND upper(event_type) = 'VIEW' AND value > 50 AS adaptive FROM events", "")
def adaptive_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sample belongs to the scope: data set, tier and target."""
    return table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") == 3) & (F.upper("event_type") == "VIEW") & (F.col("value") > 50)).alias("adaptive"))


@query("SELECT event_id, event_type || ' (' || printf('%.1f', (event_id % 1000) / 10) || ' %' || CASE WHEN event_id % 1000 >= 500 THEN '' ELSE ', uncertain' END || ')' AS words FROM events", "")
def finding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rp.finding_text(F.col("event_type"), (F.col("event_id") % 1000) / 1000).alias("words"))


@query("SELECT event_id, event_type AS kept FROM events", "")
def nested_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value under nested keys."""
    payload = F.struct(F.struct(F.struct(F.col("event_type").alias("BVP")).alias("wrist")).alias("signal"))
    return table(spark, sf_dir, "events").select("event_id", payload.alias("p")).select("event_id", recordings.nested(F.col("p"), "signal.wrist.BVP").alias("kept"))


@query("SELECT b.event_id, a.n AS notes FROM m b LEFT JOIN (SELECT event_id, count(*) AS n FROM m WHERE event_type = 'click' GROUP BY ALL) a USING (event_id)")
def annotation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose annotation is missing stay, without it."""
    rows = windows(spark, sf_dir)
    return rows.join(rows.where("event_type = 'click'").groupBy("event_id").agg(F.count(F.lit(1)).alias("notes")), "event_id", "left").select("event_id", "notes")


@query("SELECT event_id, off_us + recording_id * 5000 AS at, greatest(off_us, 1000000000) AS span_start FROM m WHERE off_us < 900000000000")
def absolute_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a segment shifted to the recording's, spans clipped to the segment."""
    rows = windows(spark, sf_dir).where("off_us < 900000000000")
    return rows.select("event_id", (F.col("off_us") + F.col("recording_id") * 5000).alias("at"), F.greatest("off_us", F.lit(1_000_000_000)).alias("span_start"))


@query("SELECT c_custkey, o AS place FROM (VALUES (7, 0), (3, 1), (99999999, 2), (5, 3)) v(k, o) JOIN customer ON c_custkey = k", "")
def records_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order asked, unknown ids left out."""
    asked = spark.range(1).select(F.posexplode(F.array(*(F.lit(k).cast("bigint") for k in (7, 3, 99_999_999, 5)))).alias("place", "c_custkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(asked), "c_custkey").select("c_custkey", "place")


@query("SELECT subject_id, count(*) AS states FROM m WHERE rhythm_class IS NOT NULL GROUP BY ALL")
def patient_context_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts kept as JSON and loaded again."""
    path = _folder(spark, "contexts")
    windows(spark, sf_dir).where("rhythm_class IS NOT NULL").groupBy("subject_id").agg(F.count(F.lit(1)).alias("states")).write.json(path)
    return spark.read.schema("subject_id long, states long").json(path)


# --- signal kernels on signals whose answer is known --------------------------------------------------


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sines of 0.75 to 2.75 Hz, 64 s at 16 Hz, one a nation."""
    ship(spark)
    f = 0.75 + (F.col("n_nationkey") % 9) * 0.25
    t = F.sequence(F.lit(0), F.lit(1023))
    return table(spark, sf_dir, "nation").select("n_nationkey", f.alias("f")).withColumn("x", F.transform(t, lambda k: F.sin(2 * 3.141592653589793 * F.col("f") * k / 16.0)))


@query("SELECT n_nationkey, round(0.75 + (n_nationkey % 9) * 0.25, 6) AS hz, 1.0 AS share, round((0.75 + (n_nationkey % 9) * 0.25) * 60, 6) AS bpm FROM nation", "")
def dominant_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _waves(spark, sf_dir).select("n_nationkey", sg.dominant_frequency("x", F.lit(16.0)).alias("d"), sg.dominant_rate("x", F.lit(16.0)).alias("r"))
    return rows.select("n_nationkey", F.round(F.get("d", F.lit(0)), 6).alias("hz"), F.round(F.get("d", F.lit(1)), 6).alias("share"), F.round(F.get("r", F.lit(0)), 6).alias("bpm"))


@query("SELECT n_nationkey, TRUE AS right_count, TRUE AS far_apart FROM nation", "")
def pulse_peak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One peak a cycle (the last may be cut off), with the doubled notch suppressed."""
    rows = _waves(spark, sf_dir).withColumn("p", sg.pulse_peaks("x", F.lit(16.0)))
    near = F.abs(F.size("p") - F.col("f") * 64) <= 1
    gap = F.array_min(vt.differences(F.col("p").cast("array<double>"))) >= 0.5 * 16 / F.col("f")
    return rows.select("n_nationkey", near.alias("right_count"), gap.alias("far_apart"))


@query("SELECT n_nationkey, 0.707107 AS inside, 0.0 AS outside FROM nation", "")
def band_pass_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is inside the band stays, a wave beyond it goes."""
    rms = lambda c: F.round(F.sqrt(vt.mean(F.transform(c, lambda v: v * v))), 6)
    rows = _waves(spark, sf_dir).withColumn("fast", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda k: F.sin(2 * 3.141592653589793 * 6.0 * k / 16.0)))
    found = rows.select("n_nationkey", sg.band_pass("x", F.lit(16.0)).alias("a"), sg.band_pass("fast", F.lit(16.0)).alias("b"))
    return found.select("n_nationkey", rms("a").alias("inside"), rms("b").alias("outside"))


@query("SELECT n_nationkey, '0.00,' || printf('%.2f', n_nationkey * 2.5) || ',' || printf('%.2f', n_nationkey * 5.0) AS points FROM nation", "")
def resampled_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ramp of six values resampled to three."""
    ship(spark)
    ramp = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: k * F.col("n_nationkey") * F.lit(1.0))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", sg.resampled(ramp, F.lit(3.0)).alias("r"))
    return rows.select("n_nationkey", F.array_join(F.transform("r", lambda x: F.format_string("%.2f", x)), ",").alias("points"))


@query("SELECT n_nationkey, TRUE AS qrs_fits, TRUE AS pr_fits, '' AS findings FROM nation", "")
def wave_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats drawn from known waves: their intervals are found where they were drawn."""
    ship(spark)
    bump = lambda u, c, w, a: a * F.exp(-F.pow((u - c) / w, F.lit(2.0)))
    drawn = lambda u: bump(u, 0.30, 0.02, 0.15) + bump(u, 0.46, 0.008, -0.02) + bump(u, 0.48, 0.012, 1.0) + bump(u, 0.50, 0.008, -0.05) + bump(u, 0.75, 0.04, 0.3)
    signal = F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda k: drawn((k % 500) / 500.0))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(500.0).alias("rate"), signal.alias("x")).select("n_nationkey", mo.wave_intervals(F.col("x"), F.col("rate")).alias("w"))
    return rows.select("n_nationkey", F.col("w.qrs_ms").between(40, 120).alias("qrs_fits"), F.col("w.pr_ms").between(120, 220).alias("pr_fits"), F.array_join(mo.findings(F.col("w")), ",").alias("findings"))


