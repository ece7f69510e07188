"""The physiological model read from the driver's `events` table, once for Spark and once as SQL.

Every event is a beat and opens a window that lasts until the subject's next event.  Times are integer
microseconds since 2024-01-01, so that both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000
DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US
ORDER = ["off_us", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, recording_id, event_id, window_index, off_us, end_us, dur_us, rhythm_class, hr_bpm, rr_ms, rr_reg, event_type, value, props."""
    line = Window.partitionBy("subject_id").orderBy(*ORDER)
    off = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    rhythm = F.when(F.col("event_type").isin("click", "view"), "N").when(F.col("event_type") == "purchase", "AF").when(F.col("event_type") == "signup", "Other")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("subject_id"),
            F.floor(off / WEEK_US).alias("recording_id"),
            "event_id",
            off.alias("off_us"),
            rhythm.alias("rhythm_class"),
            F.when(F.col("event_type") != "error", 20 + 2 * F.col("value")).alias("hr_bpm"),
            (500 + F.col("value")).alias("rr_ms"),
            (800 + F.col("value") / 10).alias("rr_reg"),
            "event_type",
            "value",
            "props",
        )
        .withColumn("window_index", F.row_number().over(line) - 1)
        .withColumn("end_us", F.lead("off_us").over(line))
        .withColumn("dur_us", F.col("end_us") - F.col("off_us"))
    )


#: Common table expression `m` with the same rows.
SQL = f"""
WITH e0 AS (SELECT user_id AS subject_id, epoch_us(ts) - {EPOCH_US} AS off_us, event_id, event_type, value, props FROM events),
m AS (SELECT subject_id, CAST(floor(off_us / {WEEK_US}.0) AS BIGINT) AS recording_id, event_id, off_us,
  CASE WHEN event_type IN ('click', 'view') THEN 'N' WHEN event_type = 'purchase' THEN 'AF' WHEN event_type = 'signup' THEN 'Other' END AS rhythm_class,
  CASE WHEN event_type <> 'error' THEN 20 + 2 * value END AS hr_bpm, 500 + value AS rr_ms, 800 + value / 10 AS rr_reg, event_type, value, props,
  row_number() OVER w - 1 AS window_index, lead(off_us) OVER w AS end_us, lead(off_us) OVER w - off_us AS dur_us
  FROM e0 WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id))
"""
