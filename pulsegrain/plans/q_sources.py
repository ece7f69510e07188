"""Sources and sinks: each query writes through a sink to the shared folder and reads back through a source."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.runtime import shared_folder, ship
from pulsegrain.sources import clinical, records, recordings, sinks, wfdb

from . import q_vitals
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


@query("SELECT 's' || event_id AS state_id, subject_id::VARCHAR AS subject_id, CASE WHEN event_type <> 'signup' THEN rhythm_class END AS rhythm_class, hr_bpm, window_index FROM m")
def state_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States written as lines (nulls left out), read under the schema: blank lines and unknown fields are ignored, Unknown is null."""
    path = _folder(spark, "states")
    rows = windows(spark, sf_dir).select(F.concat(F.lit("s"), "event_id").alias("state_id"), F.col("subject_id").cast("string"), F.when(F.col("event_type") == "signup", "Unknown").otherwise(F.col("rhythm_class")).alias("rhythm_class"), "hr_bpm", "window_index", F.lit(1).alias("not_in_the_schema"))
    sinks.write_lines(rows, path)
    spark.createDataFrame([("",), ("   ",)], "value string").write.mode("append").text(path)
    return records.read_states(spark, path).where("state_id IS NOT NULL").select("state_id", "subject_id", "rhythm_class", "hr_bpm", F.col("window_index").cast("bigint"))


@query("SELECT 'q' || event_id AS question_id, 's' || user_id AS state_id, event_type AS answer, CASE WHEN event_id % 2 = 0 THEN 0.5 END AS numeric_tolerance, CASE WHEN event_id % 3 = 0 THEN 2 END AS options, 'B' AS tier FROM events", "")
def question_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as lines, read with every broken line an error, and split into three views."""
    path, e = _folder(spark, "questions"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("q"), e).alias("question_id"), F.concat(F.lit("s"), "user_id").alias("state_id"), F.lit("B").alias("tier"), F.lit("which?").alias("question"), F.array("event_type").alias("answer"),
        F.when(e % 2 == 0, 0.5).alias("numeric_tolerance"), F.when(e % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("answer_set"), F.lit("boolean_match").alias("evaluation_method"),
    )
    sinks.write_lines(rows, path)
    agent, scoring, rest = records.views(records.read_questions(spark, path))
    whole = agent.join(scoring, "question_id").join(rest, "question_id")
    return whole.select("question_id", "state_id", F.get("answer", F.lit(0)).alias("answer"), "numeric_tolerance", F.when(F.col("answer_set").isNotNull(), F.size("answer_set")).alias("options"), "tier")


_REPLAY = q_vitals._TRACK + ", wl AS (SELECT subject_id, count(*) AS windows, count(*) FILTER (rules <> '') AS interventions, max(CASE WHEN rules <> '' THEN off_us / 1e6 END) AS last_alert_s FROM x GROUP BY ALL)"


def _replayed(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "replay")
    judged = q_vitals._evaluated(spark, sf_dir).withColumn("patient_id", F.col("subject_id").cast("string")).withColumn("offset_s", F.col("off_us") / 1e6)
    fired = judged.where(F.size("triggered") > 0)
    alert = sinks.context_alert("patient_id", "offset_s", "urgency", "triggered", "reason")
    contexts = fired.groupBy("patient_id").agg(F.array_sort(F.collect_list(alert)).alias("alerts"))
    lines = sinks.replay_records(judged.select("patient_id", "offset_s", "hr_bpm"), fired.select("patient_id", "offset_s", "urgency", F.col("triggered").alias("triggered_rules")), contexts)
    sinks.write_lines(lines, path)
    return path


@query("SELECT subject_id::VARCHAR AS patient_id, windows, interventions FROM wl", SQL + _REPLAY)
def replay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a replay by type: a window each, an intervention each, and the final context."""
    rows = spark.read.json(_replayed(spark, sf_dir))
    return rows.groupBy("patient_id").agg(F.count_if(F.col("record_type") == "window").alias("windows"), F.count_if(F.col("record_type") == "intervention").alias("interventions"))


@query("SELECT subject_id::VARCHAR AS patient_id, interventions AS alerts, round(last_alert_s, 6) AS last_alert_s FROM wl WHERE interventions > 0", SQL + _REPLAY)
def replayed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context records of a replay file."""
    found = records.read_contexts(spark, _replayed(spark, sf_dir))
    return found.select("patient_id", F.size("alerts").cast("bigint").alias("alerts"), F.round(F.array_max(F.transform("alerts", lambda a: a["offset_s"])), 6).alias("last_alert_s"))


@query("SELECT subject_id::VARCHAR AS patient_id, count(*)::VARCHAR AS windows_processed, count(*) FILTER (rhythm_class = 'AF')::VARCHAR AS truth_af_windows, 25 AS columns FROM m GROUP BY ALL")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV summary of several patients and its fixed columns."""
    path = _folder(spark, "summary")
    found = windows(spark, sf_dir).groupBy(F.col("subject_id").cast("string").alias("patient_id")).agg(F.count(F.lit(1)).alias("windows_processed"), F.count_if(F.col("rhythm_class") == "AF").alias("truth_af_windows"))
    sinks.write_summary(found, path)
    back = spark.read.option("header", True).csv(path)
    return back.select("patient_id", "windows_processed", "truth_af_windows", F.lit(len(back.columns)).alias("columns"))


@query("SELECT event_type AS cause, count(*) AS n, count(*)::BIGINT AS lines, count(*)::BIGINT AS cells FROM events WHERE value > 100 GROUP BY ALL", "")
def error_analysis_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed samples as lines, as a table and as counts."""
    path = _folder(spark, "analysis")
    sinks.write_analysis(table(spark, sf_dir, "events").where("value > 100").select("event_id", F.col("event_type").alias("cause")), "cause", path)
    lines = spark.read.json(f"{path}/lines").groupBy("cause").agg(F.count(F.lit(1)).alias("lines"))
    cells = spark.read.option("header", True).csv(f"{path}/table").groupBy("cause").agg(F.count(F.lit(1)).alias("cells"))
    return spark.read.json(f"{path}/summary").join(lines, "cause").join(cells, "cause")


@query("SELECT subject_id, count(*) AS windows, max(hr_bpm) AS max_hr FROM m GROUP BY ALL")
def patient_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a patient, each in its own folder."""
    path = _folder(spark, "reports")
    sinks.write_reports(windows(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("windows"), F.max("hr_bpm").alias("max_hr")), "subject_id", path)
    return spark.read.json(path).select(F.col("subject_id").cast("bigint"), "windows", "max_hr")


@query("SELECT event_type AS stratum, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY ALL", "")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata of a split as one document."""
    path = _folder(spark, "manifest")
    sinks.write_manifest(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stratum")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.json(path).select(F.explode("strata").alias("s"), "total").select("s.stratum", "s.n", "total")


@query("SELECT event_id FROM events WHERE value > 50 AND event_id IN (SELECT o_orderkey FROM orders)", "")
def split_by_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a split whose ids a list names."""
    path = _folder(spark, "ids")
    sinks.write_ids(table(spark, sf_dir, "orders"), "o_orderkey", path)
    ids = spark.read.text(path).select(F.col("value").cast("bigint").alias("event_id"))
    return table(spark, sf_dir, "events").where("value > 50").join(ids, "event_id", "left_semi").select("event_id")


@query("""SELECT 0 AS part, '| event_type | n |' AS value UNION ALL SELECT 0, '|---|---|' UNION ALL SELECT 1, '| ' || event_type || ' | ' || count(*) || ' |' FROM events GROUP BY event_type""", "")
def markdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's table in markdown, line by line."""
    path = _folder(spark, "markdown")
    lines = sinks.markdown_table(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type"])
    lines.coalesce(1).sortWithinPartitions("line").select("value").write.text(path)
    return spark.read.text(path).select(F.when(F.col("value").startswith("| event_type") | F.col("value").startswith("|---"), 0).otherwise(1).alias("part"), "value")


@query("""SELECT subject_id, arg_max(event_id, (off_us, event_id)) AS latest, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY off_us, event_id) FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY off_us DESC, event_id DESC) AS n FROM m WHERE event_type = 'error') e WHERE n <= 3 AND e.subject_id = m.subject_id) AS events FROM m GROUP BY subject_id""")
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest window, and the last discrete events with older ones dropped."""
    latest, events = sinks.live_feed(windows(spark, sf_dir), ["subject_id"], ORDER, F.col("event_type") == "error", 3)
    listed = events.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("r"))
    return latest.select("subject_id", F.col("event_id").alias("latest")).join(listed, "subject_id", "left").select("subject_id", "latest", F.array_join(F.transform("r", lambda x: x["event_id"].cast("string")), ",").alias("events"))


_NATIONS = "SELECT n_nationkey AS k, n_regionkey AS r, 2.5 * n_nationkey + n_regionkey AS v FROM nation"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"), (2.5 * F.col("n_nationkey") + F.col("n_regionkey")).alias("v"))


@query(f"""SELECT 'table' AS format, count(*) AS samples, round(sum(v), 6) AS total, 100.0 AS rate FROM ({_NATIONS}) WHERE k <> 3 UNION ALL SELECT 'export', count(*), round(sum(v / 1000), 6), 512.0 FROM ({_NATIONS})
UNION ALL SELECT 'document', count(*), round(sum(v), 6), 250.0 FROM ({_NATIONS})""", "")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by extension: a table with a blank sample, a phone export in microvolts, a document."""
    folder, rows = _folder(spark, "uploads"), _nations(spark, sf_dir).coalesce(1).sortWithinPartitions("k")
    rows.select((F.col("k") * 10 - F.when(F.col("k") > 3, 10).otherwise(0)).alias("time_ms"), F.when(F.col("k") != 3, F.col("v")).alias("voltage")).write.option("header", True).csv(f"{folder}/a.csv")
    head = spark.createDataFrame([(-3, "Device,Watch"), (-2, "Sampling Rate,512.3 Hz"), (-1, "Unit,µV")], "k int, value string")
    head.unionByName(rows.select("k", F.col("v").cast("string").alias("value"))).coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{folder}/b.txt")
    document = rows.agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("r")).select(F.transform("r", lambda x: x["v"]).alias("signal"), F.lit(250.0).alias("sample_rate"))
    document.write.json(f"{folder}/c.json")
    out = None
    for name, path in (("table", "a.csv"), ("export", "b.txt"), ("document", "c.json")):
        read = records.read_upload(spark, f"{folder}/{path}").select(F.lit(name).alias("format"), F.size("signal").cast("bigint").alias("samples"), F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.col("sample_rate").cast("double").alias("rate"))
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT count(*) AS found, TRUE AS valid FROM region WHERE r_regionkey < 3", "")
def uploaded_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded records newest first; empty files are left out."""
    folder = _folder(spark, "listing")
    rows = table(spark, sf_dir, "region").where("r_regionkey < 3").repartition(3, "r_regionkey")
    rows.write.partitionBy("r_regionkey").json(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("path LIKE '%.json'")
    listed = clinical.newest(files, 10)
    return listed.agg(F.count(F.lit(1)).alias("found"), F.bool_and(F.col("record_id").rlike(f"^{recordings.RECORD_ID}$")).alias("valid"))


@query("SELECT r_name AS title, r_regionkey + 1 AS place, 'about ' || r_name || chr(10) || '- point' AS body FROM region", "")
def guideline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sections of a guideline."""
    path = _folder(spark, "guideline")
    text = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r")).select(F.concat(F.lit("# Guide\n\nintro\n\n"), F.array_join(F.transform("r", lambda x: F.concat(F.lit("## "), x["r_name"], F.lit("\n\nabout "), x["r_name"], F.lit("\n- point\n"))), "\n")).alias("value"))
    text.coalesce(1).write.text(path)
    return records.read_guidelines(spark, path).select("title", "place", "body")


@query("SELECT c_custkey::VARCHAR AS ecg_id, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex_text, CASE c_custkey % 4 WHEN 0 THEN 'MI' WHEN 1 THEN 'CD,MI' ELSE '' END AS classes FROM customer", "")
def clinical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record index with code dictionaries, joined with the statements' classes."""
    folder, k = _folder(spark, "index"), F.col("c_custkey")
    codes = F.when(k % 4 == 0, "{'IMI': 80.0, 'XX': 0.0}").when(k % 4 == 1, "{'IMI': 100.0, 'LBBB': 50.0}").otherwise("{'SR': 0.0}")
    table(spark, sf_dir, "customer").select(k.alias("ecg_id"), F.when(k % 3 == 0, "0.0").when(k % 3 == 1, "1").alias("sex"), codes.alias("scp_codes")).write.option("header", True).option("escape", '"').csv(f"{folder}/records")
    spark.createDataFrame([("IMI", "1.0", "MI"), ("LBBB", "1.0", "CD"), ("SR", None, None)], "code string, diagnostic string, diagnostic_class string").coalesce(1).write.option("header", True).csv(f"{folder}/statements")
    return clinical.read_index(spark, f"{folder}/records", f"{folder}/statements").select("ecg_id", "sex_text", F.array_join("classes", ",").alias("classes"))


def _wfdb(spark: SparkSession, sf_dir: str) -> str:
    """Nations as the samples of one record a region, ten samples each; every third nation is a beat, rhythm notes at the ends."""
    folder = _folder(spark, "wfdb")
    held: dict[int, list[int]] = {}
    for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect():
        held.setdefault(r[0], []).append(r[1])
    for region, nations in held.items():
        signal = [n / 10 for n in nations for _ in range(10)]
        marks = [(10 * k + 5, "N", "") for k, n in enumerate(nations) if n % 3 == 0] + [(2, "+", "(AFIB"), (31, "+", "(N")]
        wfdb.write_record(Path(folder.removeprefix("file:")), f"r{region}", 50, {"II": signal, "V1": [-x for x in signal]}, marks)
    ship(spark)
    spark.dataSource.register(wfdb.WfdbSource)
    return folder


_RANK = "SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation"


@query(f"""SELECT 'r' || n_regionkey AS record, 50.0 AS fs, round(sum(n_nationkey / 10.0 * greatest(0, least(40, 10 * k + 10) - greatest(15, 10 * k))), 6) AS total, count(*) FILTER (n_nationkey % 3 = 0 AND 10 * k + 5 >= 15 AND 10 * k + 5 < 40) AS beats, '(N@16' AS notes FROM ({_RANK}) GROUP BY n_regionkey""", "")
def wfdb_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample range of records: signals, beats (rhythm marks are none) and notes, all from the start of the range."""
    folder = _wfdb(spark, sf_dir)
    names = ",".join(f"r{r[0]}" for r in table(spark, sf_dir, "nation").select("n_regionkey").distinct().collect())
    rows = spark.read.format("wfdb").option("root", folder.removeprefix("file:")).option("records", names).option("sampfrom", 15).option("sampto", 40).load()
    notes = F.array_join(F.transform("notes", lambda n: F.concat_ws("@", n["note"], n["sample"])), ",")
    return rows.select("record", "fs", F.round(F.aggregate(F.get("signals", F.lit(0)), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("beats").cast("bigint").alias("beats"), notes.alias("notes"))


@query("SELECT 'r' || n_regionkey AS record, 10 * count(*) AS n_samples, 'II,V1' AS leads FROM nation GROUP BY n_regionkey", "")
def wfdb_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers alone: no signal is read."""
    folder = _wfdb(spark, sf_dir)
    names = ",".join(f"r{r[0]}" for r in table(spark, sf_dir, "nation").select("n_regionkey").distinct().collect())
    rows = spark.read.format("wfdb").option("root", folder.removeprefix("file:")).option("records", names).option("headeronly", True).load()
    return rows.select("record", "n_samples", F.array_join("leads", ",").alias("leads"))


@query("SELECT subject_id, recording_id AS segment_id, count(*) AS windows FROM m WHERE subject_id % 5 = 0 GROUP BY ALL")
def patient_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).where("subject_id % 5 = 0").groupBy("subject_id", F.col("recording_id").alias("segment_id")).agg(F.count(F.lit(1)).alias("windows"))


@query("SELECT subject_id, 20::BIGINT AS start, count(*) AS samples, round(sum(value), 6) AS total FROM m WHERE window_index >= 20 AND window_index < 45 GROUP BY ALL")
def reference_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a long signal stored in blocks: other blocks are not read."""
    path = _folder(spark, "blocks")
    recordings.write_blocks(windows(spark, sf_dir), path, ["subject_id"], "window_index", "value", 16)
    found = recordings.read_range(spark, path, ["subject_id"], 20, 45)
    return found.select("subject_id", F.col("start").cast("bigint"), F.size("samples").cast("bigint").alias("samples"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = windows(spark, sf_dir).groupBy("subject_id", "recording_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "value"))).alias("r"))
    green = F.transform("r", lambda x: x["value"])
    start = F.col("recording_id") * 100.0
    return listed.select(F.col("subject_id").alias("patient"), F.col("recording_id").alias("chunk"), start.alias("start_s"), (start + F.size("r") / 4.0).alias("end_s"), F.lit(4.0).alias("rate"), F.lit(2.0).alias("accel_rate"), green.alias("green"), *(F.filter(green, lambda x, i: i % 2 == 0).alias(c) for c in ("accel_x", "accel_y", "accel_z")))


@query("SELECT subject_id AS patient, recording_id AS chunk, recording_id * 100.0 AS start_s, 7 AS columns FROM m GROUP BY ALL")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without their signals."""
    path = _folder(spark, "chunks")
    _chunks(spark, sf_dir).withColumn("device", F.lit("w")).write.parquet(path)
    back = recordings.read_chunks(spark, path, include_signals=False)
    return back.select("patient", "chunk", "start_s", F.lit(len(back.columns)).alias("columns"))


@query("""SELECT patient, chunk, kind, array_to_string(list_transform(l[lo + 1:hi], lambda x: printf('%.2f', x)), ',') AS green, array_to_string(list_transform(a[lo // 2 + 1:hi // 2], lambda x: printf('%.2f', x)), ',') AS accel FROM (
SELECT subject_id AS patient, recording_id AS chunk, l, list_filter(l, lambda x, i: i % 2 = 1) AS a, unnest([{'kind': 'window', 'lo': 1, 'hi': 4}, {'kind': 'time', 'lo': 2, 'hi': 4}, {'kind': 'whole', 'lo': 0, 'hi': len(l)}], recursive := true)
FROM (SELECT subject_id, recording_id, list(value ORDER BY off_us, event_id) AS l FROM m GROUP BY ALL)) WHERE (kind = 'whole' AND chunk = 0) OR (kind = 'window' AND chunk = 1 AND len(l) >= 4) OR (kind = 'time' AND chunk = 2 AND len(l) >= 4)""")
def signal_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of signals by window id, by a time range that a chunk holds as a whole, and whole chunks."""
    chunks = _chunks(spark, sf_dir)
    patients = chunks.select("patient").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    window = "struct<chunk:bigint,start:bigint,end:bigint>"
    ask = lambda kind, w, a, b: patients.select(F.concat_ws("-", "patient", F.lit(kind)).alias("request_id"), "patient", none("bigint").alias("chunk"), w.alias("window"), a.alias("from_s"), b.alias("to_s"))
    requests = ask("window", F.struct(F.lit(1).alias("chunk"), F.lit(1).alias("start"), F.lit(4).alias("end")).cast(window), none("double"), none("double")).unionByName(ask("time", none(window), F.lit(200.5), F.lit(201.0))).unionByName(ask("whole", none(window), none("double"), none("double")))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.2f", x)), ",")
    found = recordings.signal_views(requests, chunks)
    return found.select("patient", "chunk", F.element_at(F.split("request_id", "-"), -1).alias("kind"), text("green").alias("green"), text("accel_x_part").alias("accel"))


@query("SELECT 'aw.1' AS record_id, count(*) AS samples, round(sum(v), 6) AS total FROM (" + _NATIONS + ")", "")
def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record written under a valid id and fetched twice from one read."""
    store = recordings.RecordStore(spark, _folder(spark, "records"))
    row = _nations(spark, sf_dir).agg(F.array_sort(F.collect_list("v")).alias("samples")).withColumns({"sampling_rate": F.lit(250), "lead_name": F.lit("I")})
    name = store.write(row, " aw.1 ")
    assert store.get(name) is store.get(name)
    return store.get(name).select("record_id", F.size("samples").cast("bigint").alias("samples"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT c_custkey AS patient, 'p' || c_custkey AS name FROM customer WHERE c_custkey BETWEEN 1 AND 5", "")
def patient_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients of a directory layout."""
    folder = _folder(spark, "layout")
    for k in range(1, 6):
        table(spark, sf_dir, "customer").where(F.col("c_custkey") == k).select("c_name").coalesce(1).write.text(f"{folder}/p{k:05d}/x")
    return clinical.patients(spark, folder).select(F.col("patient").cast("bigint")).distinct().select("patient", F.concat(F.lit("p"), "patient").alias("name"))


@query("SELECT rule_id, count(*) AS n FROM (SELECT unnest(string_split(rules, ',')) AS rule_id FROM x WHERE rules <> '') GROUP BY ALL", SQL + q_vitals._TRACK)
def published_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that a stream's side has published as a table, read by the query side."""
    path = _folder(spark, "published")
    q_vitals._evaluated(spark, sf_dir).where(F.size("triggered") > 0).select("event_id", "triggered").write.parquet(path)
    return spark.read.parquet(path).select(F.explode("triggered").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))

