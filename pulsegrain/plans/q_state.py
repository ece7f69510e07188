"""State-store queries: contexts, lookups, as-of, previous, and trend summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.operators import sequence as seq
from pulsegrain.operators import state as st
from pulsegrain.schema import canonical_dataset

from .testdata_model import DAY_US, ORDER, SQL, table, windows

LINE = ["subject_id", "recording_id"]
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None, model: bool = True):
    """Registers a query under its function's name with the SQL of the same result."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = (SQL if model else "") + sql
        return function

    return register


@query("""SELECT subject_id, recording_id, arg_min(event_type, window_index) AS modality, count(*) AS state_count, min(off_us) AS start_us, max(end_us) AS end_us
FROM m GROUP BY ALL""")
def state_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.contexts(windows(spark, sf_dir), LINE, "window_index", "event_type", "off_us", "end_us")
    return found.withColumnsRenamed({"start": "start_us", "end": "end_us"})


@query(f"SELECT subject_id, event_id, window_index FROM m WHERE off_us < {9 * DAY_US} AND end_us > {7 * DAY_US}")
def state_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.overlapping(windows(spark, sf_dir), 7 * DAY_US, 9 * DAY_US, "off_us", "end_us").select("subject_id", "event_id", "window_index")


@query(f"""SELECT p.subject_id, p.at_us, s.event_id AS picked, coalesce(s.end_us > p.at_us, FALSE) AS contains
FROM (SELECT DISTINCT subject_id, d * {DAY_US} AS at_us FROM m, range(0, 32, 3) r(d)) p ASOF LEFT JOIN (SELECT * FROM m WHERE end_us IS NOT NULL) s ON p.subject_id = s.subject_id AND p.at_us >= s.off_us""")
def state_current_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir)
    probes = rows.select("subject_id").distinct().select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(31), F.lit(3))).alias("d")).select("subject_id", (F.col("d") * F.lit(DAY_US)).alias("at_us"))
    found = st.current_as_of(rows, probes, ["subject_id"], "off_us", "end_us", "event_id", "at_us")
    return found.withColumn("contains", F.coalesce("contains", F.lit(False)))


@query("""SELECT event_id, lag(hr_bpm, 2) OVER w AS previous_hr_bpm, lag(rhythm_class, 2) OVER w AS previous_rhythm_class
FROM m WINDOW w AS (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id)""")
def state_previous_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.previous(windows(spark, sf_dir), LINE, ORDER, ["hr_bpm", "rhythm_class"], 2).select("event_id", "previous_hr_bpm", "previous_rhythm_class")


@query(f"""SELECT event_id, CASE WHEN off_us - lag(end_us) OVER w <= {DAY_US // 24} THEN lag(hr_bpm) OVER w END AS previous_hr_bpm
FROM m WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)""")
def state_previous_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = windows(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    return st.previous_if_adjacent(kept, ["subject_id"], ORDER, "off_us", "end_us", "hr_bpm", DAY_US // 24).select("event_id", "previous_hr_bpm")


@query("SELECT event_id, lag(hr_bpm) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS previous_hr_bpm FROM m WHERE rhythm_class IN ('N', 'AF')")
def state_previous_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = windows(spark, sf_dir).where(F.col("rhythm_class").isin("N", "AF"))
    return st.previous(clean, ["subject_id"], ORDER, ["hr_bpm"]).select("event_id", "previous_hr_bpm")


@query("SELECT event_id, subject_id, off_us FROM m WHERE event_id = 77")
def state_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.matching(windows(spark, sf_dir), event_id=77).select("event_id", "subject_id", "off_us")


@query("SELECT event_id, subject_id FROM m WHERE subject_id = 5 AND recording_id = 1")
def state_context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.matching(windows(spark, sf_dir), subject_id=5, recording_id=1, rhythm_class=None).select("event_id", "subject_id")


@query("""SELECT event_id, CAST((hr_bpm IS NULL)::INT + (rhythm_class IS NULL)::INT + (end_us IS NULL)::INT AS INT) AS n_missing,
hr_bpm IS NOT NULL AND rhythm_class IS NOT NULL AND end_us IS NOT NULL AS complete FROM m""")
def state_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.missing_fields(windows(spark, sf_dir), ["hr_bpm", "rhythm_class", "end_us"]).select("event_id", "n_missing", "complete")


@query("SELECT subject_id, max_by(event_id, (off_us, event_id)) AS event_id FROM m GROUP BY subject_id")
def state_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.last_write(windows(spark, sf_dir), "subject_id", ORDER).select("subject_id", "event_id")


@query("SELECT event_id, off_us, (SELECT count(*) FROM m WHERE rhythm_class = 'AF') AS total_count FROM m WHERE rhythm_class = 'AF' ORDER BY off_us, event_id LIMIT 20")
def state_limit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.with_total(windows(spark, sf_dir).where("rhythm_class = 'AF'"), ORDER, 20).select("event_id", "off_us", "total_count")


@query("""SELECT subject_id, recording_id, round(avg(hr_bpm), 6) AS mean_hr, min(hr_bpm) AS min_hr, max(hr_bpm) AS max_hr, count(hr_bpm) AS hr_count,
max(coalesce(CASE WHEN rhythm_class = 'AF' THEN hr_bpm + 5 END, hr_bpm)) AS peak_hr, count(coalesce(CASE WHEN rhythm_class = 'AF' THEN hr_bpm + 5 END, hr_bpm)) AS peak_count FROM m GROUP BY ALL""")
def trend_hr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = F.coalesce(F.when(F.col("rhythm_class") == "AF", F.col("hr_bpm") + 5), F.col("hr_bpm"))
    return st.hr_summary(windows(spark, sf_dir), LINE, F.col("hr_bpm"), peak).withColumn("mean_hr", F.round("mean_hr", 6))


_RATIO = "CASE WHEN rhythm_class IS NOT NULL THEN (window_index % 7) / 7.0 END"


@query(f"""SELECT subject_id, recording_id, round(avg({_RATIO}), 6) AS mean_burden, round(max({_RATIO}), 6) AS max_burden,
round(arg_max({_RATIO}, window_index) FILTER ({_RATIO} IS NOT NULL), 6) AS latest_burden, count({_RATIO}) AS burden_count,
round(avg((rhythm_class = 'AF')::INT) FILTER (rhythm_class IS NOT NULL), 6) AS label_fraction FROM m GROUP BY ALL""")
def trend_af_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("rhythm_class").isNotNull(), (F.col("window_index") % 7) / F.lit(7.0))
    found = st.burden_summary(windows(spark, sf_dir), LINE, ratio, F.col("rhythm_class"), "AF", "window_index")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_burden", "max_burden", "latest_burden", "label_fraction")})


@query("""SELECT subject_id, recording_id, count(*) FILTER (b <> rhythm_class) AS transitions
FROM (SELECT *, lag(rhythm_class) OVER (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id) AS b FROM m WHERE rhythm_class IS NOT NULL) GROUP BY ALL""")
def trend_rhythm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.transition_counts(windows(spark, sf_dir), LINE, ORDER, "rhythm_class")


@query("""SELECT subject_id, round(avg((event_type = 'purchase')::INT) FILTER (event_type <> 'error'), 6) AS label_fraction, round(avg(value), 6) AS mean_burden, max(value) AS max_burden,
arg_max(value, window_index) AS latest_burden, count(value) AS burden_count FROM m GROUP BY ALL""")
def trend_stress_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") != "error", F.col("event_type"))
    found = st.burden_summary(windows(spark, sf_dir), ["subject_id"], F.col("value"), label, "purchase", "window_index")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_burden", "label_fraction")})


@query("SELECT subject_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN dur_us END), 0)::BIGINT AS duration FROM m GROUP BY ALL")
def trend_stress_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.labelled_duration(windows(spark, sf_dir), ["subject_id"], F.col("event_type"), "purchase", F.col("dur_us"))


@query("SELECT subject_id, rhythm_class, count(*) AS n FROM m WHERE rhythm_class IS NOT NULL GROUP BY ALL")
def trend_activity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.distribution(windows(spark, sf_dir), ["subject_id"], "rhythm_class")


@query("SELECT event_type, bool_or(hr_bpm IS NOT NULL) AS heart_rate, bool_or(rhythm_class IS NOT NULL) AS rhythm, bool_or(rhythm_class IS NOT NULL AND end_us IS NOT NULL) AS burden FROM m GROUP BY ALL")
def capability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.capabilities(windows(spark, sf_dir), ["event_type"], {"heart_rate": ["hr_bpm"], "rhythm": ["rhythm_class"], "burden": ["rhythm_class", "end_us"]})


@query("""SELECT subject_id, recording_id, round(avg(hr_bpm), 6) AS mean_hr, max(hr_bpm) AS max_hr, count(hr_bpm) AS hr_count,
round(sum(CASE WHEN rhythm_class = 'AF' THEN dur_us END) / nullif(sum(CASE WHEN rhythm_class IS NOT NULL THEN dur_us END), 0), 6) AS af_burden,
coalesce(sum(CASE WHEN b <> rhythm_class THEN 1 ELSE 0 END), 0)::BIGINT AS transitions
FROM (SELECT *, lag(rhythm_class IGNORE NULLS) OVER (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id) AS b FROM m) GROUP BY ALL""")
def trend_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart-rate trend, AF burden and rhythm changes of every recording in one pass over its timeline."""
    before = F.expr("lag(rhythm_class) IGNORE NULLS OVER (PARTITION BY subject_id, recording_id ORDER BY off_us, event_id)")
    rows = windows(spark, sf_dir).withColumn("_b", before)
    burden = F.try_divide(F.sum(F.when(F.col("rhythm_class") == "AF", F.col("dur_us"))), F.sum(F.when(F.col("rhythm_class").isNotNull(), F.col("dur_us"))))
    return rows.groupBy(*LINE).agg(
        F.round(F.avg("hr_bpm"), 6).alias("mean_hr"), F.max("hr_bpm").alias("max_hr"), F.count("hr_bpm").alias("hr_count"), F.round(burden, 6).alias("af_burden"), F.count_if(F.col("_b") != F.col("rhythm_class")).alias("transitions")
    )


@query("""SELECT r_name, CASE WHEN lower(trim(r_name)) IN ('af_ppg_ecg', 'zenodo', 'zenodo_af_monitoring') THEN 'afppgecg' ELSE lower(trim(r_name)) END AS dataset FROM region
UNION ALL SELECT ' Zenodo ', 'afppgecg'""", model=False)
def canonical_dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select("r_name").unionByName(spark.sql("SELECT ' Zenodo ' AS r_name"))
    return names.select("r_name", canonical_dataset(F.col("r_name")).alias("dataset"))
