"""Streaming, drift and kernel queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.functions import signal as sg
from pulsegrain.operators import drift as dr
from pulsegrain.runtime import shared_folder, ship
from pulsegrain.streaming import tracker_stream as ts
from pulsegrain.streaming import windows_stream as ws

from .testdata_model import EPOCH_US, ORDER, SQL, table, windows

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
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _vitals(rows: DataFrame) -> DataFrame:
    rhythm = F.when(F.col("event_type").isin("click", "view"), "N").when(F.col("event_type") == "purchase", "AF").when(F.col("event_type") == "signup", "Other")
    return rows.select(F.col("user_id").alias("subject_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)).alias("off_us"), F.when(F.col("event_type") != "error", 20 + 2 * F.col("value")).alias("hr_bpm"), rhythm.alias("rhythm_class"))


_TRACK = """, u AS (SELECT *, count(*) OVER f AS samples, CASE WHEN count(hr_bpm) OVER f > 0 THEN round(avg(CASE WHEN hr_bpm > 100 THEN 1.0 ELSE 0.0 END) OVER f, 6) END AS ratio,
sum(CASE WHEN rhythm_class IN ('N', 'Other') THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS g FROM m WINDOW f AS (PARTITION BY subject_id ORDER BY off_us, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, sum(CASE WHEN rhythm_class = 'AF' THEN 10.0 END) OVER (PARTITION BY subject_id, g ORDER BY off_us, event_id)::DOUBLE AS timer,
concat_ws(',', CASE WHEN hr_bpm < 30 THEN 'extreme_bradycardia' END, CASE WHEN hr_bpm > 200 THEN 'extreme_tachycardia' END, CASE WHEN samples >= 30 AND ratio >= 0.8 THEN 'sustained_tachycardia' END) AS rules FROM u)"""


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.run_to_end(spark, ts.track_stream(_vitals(_events(spark, sf_dir))), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("SELECT event_id, samples, ratio, timer, rules FROM x", SQL + _TRACK)
def stream_tracker_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's tracker rows, equal to the batch twin's."""
    return _tracked(spark, sf_dir).select("event_id", "samples", F.round("ratio", 6).alias("ratio"), "timer", "rules")


@query("SELECT event_id, rules FROM (SELECT *, lag(rules) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS b FROM x) WHERE rules <> '' AND coalesce(b, '') <> rules", SQL + _TRACK)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.alerts(_tracked(spark, sf_dir)).select("event_id", "rules")


@query("""SELECT event_type, epoch_us(d) AS day_us, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT *, date_trunc('day', ts) AS d FROM events)
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type, d""", "")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows behind the watermark; the last open one stays in the state."""
    rows = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    done = ws.tumbling_counts(rows, "at", ["event_type"], "1 day", "1 hour").select("event_type", F.unix_micros("window.start").alias("day_us"), "n", F.round("mean_value", 6).alias("mean_value"))
    return ts.run_to_end(spark, done, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


_COLD = 20
#: The recurrence by recursion: mean vector, distances of the cold start, then their centre and spread.
_DRIFT = f"""WITH RECURSIVE o AS (SELECT label::BIGINT AS key, vec_id AS item, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
f AS (SELECT key, item, n, v AS mean, [0.0::DOUBLE] AS ds, 0.0::DOUBLE AS centre, 0.0::DOUBLE AS spread, 0.0::DOUBLE AS distance, CAST(NULL AS DOUBLE) AS z FROM o WHERE n = 0 UNION ALL
SELECT key, item, n, CASE WHEN n < {_COLD} THEN list_transform(list_zip(mean, v), lambda p: p[1] + (p[2] - p[1]) / (n + 1)) WHEN abs(zz) < 3 THEN list_transform(list_zip(mean, v), lambda p: p[1] + 0.05 * (p[2] - p[1])) ELSE mean END,
CASE WHEN n < {_COLD} THEN list_append(ds, d) ELSE ds END, CASE WHEN n = {_COLD} - 1 THEN list_avg(list_append(ds, d)) WHEN n >= {_COLD} AND abs(zz) < 3 THEN centre + 0.05 * (d - centre) ELSE centre END,
CASE WHEN n = {_COLD} - 1 THEN list_stddev_pop(list_append(ds, d)) WHEN n >= {_COLD} AND abs(zz) < 3 THEN sqrt(0.95 * spread * spread + 0.05 * pow(d - (centre + 0.05 * (d - centre)), 2)) ELSE spread END, d, CASE WHEN n >= {_COLD} THEN zz END
FROM (SELECT *, CASE WHEN spread > 1e-9 THEN (d - centre) / spread ELSE 0 END AS zz FROM (SELECT o.key, o.item, o.n, o.v, f.mean, f.ds, f.centre, f.spread, sqrt(list_sum(list_transform(list_zip(f.mean, o.v), lambda p: pow(p[2] - p[1], 2)))) AS d FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)))
SELECT key, item, round(distance, 5) AS distance, round(z, 4) AS z FROM f"""


@query(_DRIFT, "")
def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential recurrence per key."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("item"), "embedding")
    return dr.drift(vectors, _COLD).withColumns({"distance": F.round("distance", 5), "z": F.round("z", 4)})


_ENTROPY = """, l AS (SELECT subject_id, recording_id, list(rr_ms ORDER BY off_us, event_id) AS x, 0.2 * stddev_pop(rr_ms) AS r FROM m GROUP BY ALL),
t AS (SELECT subject_id, recording_id, r, x, unnest(range(1, len(x) - 1)) AS i FROM l WHERE len(x) >= 4),
p AS (SELECT a.subject_id, a.recording_id, abs(a.x[a.i] - a.x[b.i]) <= a.r AND abs(a.x[a.i + 1] - a.x[b.i + 1]) <= a.r AS two, abs(a.x[a.i + 2] - a.x[b.i + 2]) <= a.r AS third FROM t a JOIN t b ON a.subject_id = b.subject_id AND a.recording_id = b.recording_id AND a.i < b.i),
c AS (SELECT subject_id, recording_id, count(*) FILTER (two) AS b, count(*) FILTER (two AND third) AS a FROM p GROUP BY ALL)
SELECT subject_id, recording_id, CASE WHEN a > 0 AND b > 0 THEN round(ln(b / a), 6) END AS entropy FROM l LEFT JOIN c USING (subject_id, recording_id)"""


@query(_ENTROPY)
def rr_sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic in a window's values, so vectorised per window."""
    ship(spark)
    listed = windows(spark, sf_dir).groupBy("subject_id", "recording_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "rr_ms"))).alias("l"))
    return listed.select("subject_id", "recording_id", F.round(F.nanvl(sg.sample_entropy(F.transform("l", lambda v: v["rr_ms"])), F.lit(None).cast("double")), 6).alias("entropy"))
