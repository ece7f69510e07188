"""Question, scoring and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrain.functions import text as tx
from pulsegrain.operators import qa

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


_STATES = """, st AS (SELECT event_id AS state_id, subject_id, floor(hr_bpm * 10) / 10 AS hr_bpm, rhythm_class, lag(floor(hr_bpm * 10) / 10) OVER w AS previous_hr_bpm, lag(rhythm_class) OVER w AS previous_rhythm_class,
CASE WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN value > 200 THEN 'stress' ELSE 'baseline' END END AS stress_label, CAST(NULL AS VARCHAR) AS previous_stress_label,
CASE WHEN event_type = 'view' THEN (window_index % 8) / 16.0 END AS af_burden_ratio, CASE WHEN event_type = 'view' THEN floor(value) END AS max_hr_bpm, CASE WHEN event_type = 'view' THEN window_index % 6 END AS rhythm_transition_count_per_hour,
CASE WHEN event_type = 'signup' THEN (window_index % 3) / 2.0 END AS stress_burden_ratio, CASE WHEN event_type = 'signup' THEN (window_index % 50) * 30.0 END AS stress_duration_s, CASE WHEN event_type = 'signup' THEN 'amusement' END AS dominant_stress_label
FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id))"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("subject_id").orderBy(*ORDER)
    hr, kind, n = F.floor(F.col("hr_bpm") * 10) / 10, F.col("event_type"), F.col("window_index")
    return windows(spark, sf_dir).select(
        F.col("event_id").alias("state_id"),
        "subject_id",
        hr.alias("hr_bpm"),
        "rhythm_class",
        F.lag(hr).over(w).alias("previous_hr_bpm"),
        F.lag("rhythm_class").over(w).alias("previous_rhythm_class"),
        F.when(kind.isin("purchase", "signup"), F.when(F.col("value") > 200, "stress").otherwise("baseline")).alias("stress_label"),
        F.lit(None).cast("string").alias("previous_stress_label"),
        F.when(kind == "view", (n % 8) / F.lit(16.0)).alias("af_burden_ratio"),
        F.when(kind == "view", F.floor("value")).alias("max_hr_bpm"),
        F.when(kind == "view", n % 6).alias("rhythm_transition_count_per_hour"),
        F.when(kind == "signup", (n % 3) / F.lit(2.0)).alias("stress_burden_ratio"),
        F.when(kind == "signup", (n % 50) * F.lit(30.0)).alias("stress_duration_s"),
        F.when(kind == "signup", F.lit("amusement")).alias("dominant_stress_label"),
        *ORDER,
    )


def _questions_sql(columns: str) -> str:
    number = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {x}) END"
    parts = []
    for t in qa.TEMPLATES:
        for part, values in qa.combinations(t):
            for k, p in enumerate(t.phrasings):
                suffix = f"__{t.template_id}" + (f"__{part}" if part else "") + f"__p{k}"
                needed = " AND ".join(f"{c} IS NOT NULL" for c in t.required)
                parts.append(f"SELECT state_id || '{suffix}' AS question_id, state_id, '{t.template_id}' AS template_id, '{t.tier}' AS tier, '{t.kind}' AS kind, '{t.target}' AS target, {qa.answer_sql(t, values, number)} AS answer, '{p.format(**values)}' AS question FROM st WHERE {needed}")
    return _STATES + ", qs AS (" + " UNION ALL ".join(parts) + f") {columns}"


@query(_questions_sql("SELECT question_id, answer, question FROM qs"))
def qa_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.generate(_states(spark, sf_dir)).select("question_id", "answer", "question")


@query(_questions_sql("SELECT count(*) AS repeated FROM (SELECT question_id FROM qs GROUP BY 1 HAVING count(*) > 1)"))
def qa_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.generate(_states(spark, sf_dir)).groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("repeated"))


@query(_questions_sql("SELECT tier, kind, target, count(*) AS n FROM qs GROUP BY GROUPING SETS ((tier), (kind), (target), (tier, kind))"))
def qa_summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qa.generate(_states(spark, sf_dir))
    c = F.col
    return q.groupingSets([[c("tier")], [c("kind")], [c("target")], [c("tier"), c("kind")]], c("tier"), c("kind"), c("target")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t.template_id}', '{t.tier}', '{t.kind}', '{t.target}', {len(t.phrasings)})" for t in qa.TEMPLATES if t.tier == "B") + ") v(template_id, tier, kind, target, phrasings)", "")
def template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t.template_id, t.tier, t.kind, t.target, len(t.phrasings)) for t in qa.select_templates(tier="B")], "template_id string, tier string, kind string, target string, phrasings int")


@query(_STATES + """SELECT state_id, 'hr_bpm' AS metric, round(hr_bpm - previous_hr_bpm, 6) AS delta, CASE WHEN hr_bpm > previous_hr_bpm THEN 'up' WHEN hr_bpm < previous_hr_bpm THEN 'down' WHEN hr_bpm = previous_hr_bpm THEN 'same' END AS direction,
abs(hr_bpm - previous_hr_bpm) >= 5 AS changed FROM st UNION ALL SELECT state_id, 'rhythm_class', NULL, NULL, rhythm_class <> previous_rhythm_class FROM st""")
def prev_window_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.compare_previous(_states(spark, sf_dir), ["subject_id"], ORDER, ["hr_bpm"], ["rhythm_class"], "state_id").withColumn("delta", F.round("delta", 6))


_TEXT = """CASE event_id % 8 WHEN 0 THEN 'Yes, this window is positive.' WHEN 1 THEN 'Answer: not detected!' WHEN 2 THEN 'A. low heart rate' WHEN 3 THEN 'high' WHEN 4 THEN 'Normal - probably' WHEN 5 THEN 'about ' || CAST(floor(value) AS BIGINT) || ' bpm'
WHEN 6 THEN '' ELSE 'Detected: absent' END"""
_NORM = r"""trim(regexp_replace(regexp_replace(lower(regexp_replace(t, '^\s*answer\s*:\s*', '', 'i')), '[!\x22#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\s+', ' ', 'g'))"""
_PREDICTIONS = f", tp AS (SELECT event_id, value, rhythm_class, {_TEXT} AS t FROM m), tn AS (SELECT *, {_NORM} AS s FROM tp)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("event_id", "subject_id", "value", "rhythm_class", "off_us", F.expr(_TEXT).alias("t"))


@query(_PREDICTIONS + """SELECT event_id, coalesce(b = (rhythm_class = 'AF'), FALSE) AS score FROM (SELECT *, CASE WHEN array_to_string(string_split(s, ' ')[1:2], ' ') IN ('no', 'false', 'absent', 'not detected', 'normal', 'negative') THEN FALSE
WHEN string_split(s, ' ')[1] IN ('yes', 'true', 'present', 'detected', 'abnormal', 'positive') THEN TRUE WHEN string_split(s, ' ')[1] IN ('no', 'false', 'absent', 'not detected', 'normal', 'negative') THEN FALSE END AS b FROM tn)""")
def score_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("rhythm_class") == "AF", "yes").when(F.col("rhythm_class").isNotNull(), "no")
    return _predictions(spark, sf_dir).select("event_id", tx.boolean_score(F.col("t"), gold).alias("score"))


@query(_PREDICTIONS + """SELECT event_id, coalesce(coalesce(CASE WHEN s = 'low' OR starts_with(s, 'low ') THEN 'low' END, CASE WHEN s = 'normal' OR starts_with(s, 'normal ') THEN 'normal' END, CASE WHEN s = 'high' OR starts_with(s, 'high ') THEN 'high' END,
CASE WHEN list_contains(string_split(s, ' '), 'low') THEN 'low' END, CASE WHEN list_contains(string_split(s, ' '), 'normal') THEN 'normal' END, CASE WHEN list_contains(string_split(s, ' '), 'high') THEN 'high' END, s)
= CASE WHEN value < 60 THEN 'low' WHEN value > 100 THEN 'high' ELSE 'normal' END, FALSE) AS score FROM tn""")
def score_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("value") < 60, "low").when(F.col("value") > 100, "high").otherwise("normal")
    return _predictions(spark, sf_dir).select("event_id", tx.category_score(F.col("t"), gold, ["low", "normal", "high"]).alias("score"))


@query(_PREDICTIONS + r"SELECT event_id, coalesce(abs(try_cast(nullif(regexp_extract(t, '[-+]?(?:\d*\.\d+|\d+)'), '') AS DOUBLE) - value) <= 0.5, FALSE) AS score FROM tn")
def score_numeric_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("event_id", tx.within(tx.first_number(F.col("t")), F.col("value"), F.lit(0.5)).alias("score"))


_NUMBERS = f"""CASE event_id % 5 WHEN 0 THEN 'min 31 and max ' || CAST(floor(value) AS BIGINT) || ' over this window; the pulse rate seems to be approximately ' || round(value + 0.25, 2) || ' now'
WHEN 1 THEN 'normal range is 60-100, I would say about ' || CAST(floor(value) AS BIGINT) WHEN 2 THEN CAST(floor(value) AS BIGINT) || ' bpm' WHEN 3 THEN 'no number' ELSE 'window 12 started; it took ' || (event_id % 90) || ' of them, then -3.5 and .5' END"""
_CUED = f""", np AS (SELECT event_id, event_type, value, {_NUMBERS} AS t FROM m), nl AS (SELECT *, regexp_extract_all(t, '{tx.NUMBER}') AS n, string_split_regex(t, '{tx.NUMBER}') AS p FROM np),
nx AS (SELECT *, list_transform(range(1, len(n) + 1), lambda i: {{'v': CAST(n[i] AS DOUBLE), 's': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(n[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'l': length(n[i])}}) AS c FROM nl),
ny AS (SELECT *, list_transform(c, lambda x: {{'v': x.v, 'near': substr(t, greatest(x.s - {tx.REACH}, 0) + 1, x.s + x.l + {tx.REACH} - greatest(x.s - {tx.REACH}, 0))}}) AS w FROM nx),
nz AS (SELECT *, list_transform(list_filter(w, lambda x: regexp_matches(x.near, '(?i){tx.CUE}') AND NOT regexp_matches(x.near, '(?i){tx.DISTRACTOR}')), lambda x: x.v) AS f FROM ny)"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("event_id", "event_type", "value", F.expr(_NUMBERS.replace("CAST(floor(value) AS BIGINT)", "CAST(floor(value) AS STRING)")).alias("t"))


@query(_CUED + "SELECT event_id, array_to_string(list_transform(f, lambda x: printf('%.2f', x)), ',') AS preferred FROM nz")
def answer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(tx.answer_numbers(F.col("t")), lambda x: F.format_string("%.2f", x))
    return _numbers(spark, sf_dir).select("event_id", F.array_join(found, ",").alias("preferred"))


_NUMERIC = "coalesce(CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda x: abs(x - value) <= 0.5)) > 0 ELSE abs(n[1]::DOUBLE - value) <= 0.5 END, FALSE)"


@query(_CUED + f"SELECT event_id, {_NUMERIC} AS score FROM nz")
def score_numeric_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with cues near them, else the first number."""
    return _numbers(spark, sf_dir).select("event_id", tx.numeric_score(F.col("t"), F.col("value").cast("string"), F.lit(0.5)).alias("score"))


@query(_CUED + f"SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN {_NUMERIC} WHEN event_type = 'purchase' THEN t = 'no number' ELSE FALSE END AS score FROM nz")
def score_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row by its own evaluation method."""
    kind = F.col("event_type")
    method = F.when(kind.isin("view", "click"), "numeric_tolerance").when(kind == "purchase", "normalized_match").otherwise("boolean_match")
    gold = F.when(kind == "purchase", "no number").otherwise(F.col("value").cast("string"))
    return _numbers(spark, sf_dir).select("event_id", tx.score(method, F.col("t"), gold, F.lit(0.5), ["yes number"]).alias("score"))


@query("""SELECT rhythm_class, event_type, count(*) AS n, round(avg(CASE WHEN value > 200 THEN 1 WHEN value > 100 THEN 0 ELSE 0 END), 9) AS accuracy FROM m GROUP BY GROUPING SETS ((), (rhythm_class), (event_type))""")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = windows(spark, sf_dir).withColumn("score", F.when(F.col("value") > 200, True).when(F.col("value") > 100, False))
    return qa.accuracy(scored, ["rhythm_class", "event_type"]).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT c AS category, count(*) FILTER (event_type = c) AS n FROM m, (VALUES ('click'), ('view'), ('purchase'), ('refund')) v(c) GROUP BY ALL")
def routing_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.routing(windows(spark, sf_dir), "event_type", ["click", "view", "purchase", "refund"])


@query("SELECT subject_id, arg_max(rhythm_class, (n, -f)) AS vote, max(n) AS votes FROM (SELECT subject_id, rhythm_class, count(*) AS n, min(window_index) AS f FROM m WHERE rhythm_class IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.majority(windows(spark, sf_dir), ["subject_id"], "rhythm_class", "window_index")


# --- text and JSON ----------------------------------------------------------------------------


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS stripped FROM pages", "")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("stripped"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events", "")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.json_number(F.col("props"), "$.k").alias("k"), F.array_join(tx.json_keys(F.col("props")), ",").alias("keys"))


@query(r"""SELECT c_custkey, CASE WHEN regexp_matches(r, '^(uploaded|clinical):') THEN regexp_extract(r, '^([a-z]+):', 1) ELSE 'clinical' END AS source, CASE WHEN regexp_matches(r, '^(uploaded|clinical):') THEN regexp_extract(r, '^[^:]*:(.*)$', 1) ELSE r END AS id
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'uploaded:' || c_custkey WHEN 1 THEN 'other:' || c_custkey ELSE c_name END AS r FROM customer)""", "")
def locator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('uploaded:', c_custkey) WHEN 1 THEN concat('other:', c_custkey) ELSE c_name END").alias("r"))
    source, identity = tx.record_reference(F.col("r"))
    return rows.select("c_custkey", source.alias("source"), identity.alias("id"))


@query("SELECT event_id, printf('ppg:%d:chunk%03d:w%06d:s%09d-e%09d', subject_id, recording_id, window_index, off_us // 1000000, end_us // 1000000) AS window_id, end_us // 1000000 > off_us // 1000000 AS valid FROM m WHERE end_us IS NOT NULL")
def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).where("end_us IS NOT NULL")
    made = rows.select("event_id", tx.window_id(F.col("subject_id").cast("string"), F.col("recording_id"), F.col("window_index"), F.floor(F.col("off_us") / 1_000_000), F.floor(F.col("end_us") / 1_000_000)).alias("window_id"))
    return made.select("event_id", "window_id", tx.parse_window_id(F.col("window_id")).isNotNull().alias("valid"))


@query(r"SELECT c_custkey, 'S' || lpad(CAST(c_custkey AS VARCHAR), greatest(5, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS id, CAST(c_custkey % 24 AS DOUBLE) * 3600 + (c_custkey % 60) * 60 + c_custkey % 60 AS seconds FROM customer", "")
def id_and_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    clock = F.concat_ws(":", F.col("c_custkey") % 24, F.col("c_custkey") % 60, F.col("c_custkey") % 60)
    return rows.select("c_custkey", tx.padded_id(F.col("c_custkey").cast("string"), 5, "S").alias("id"), tx.clock_seconds(clock).alias("seconds"))


@query(r"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: upper(trim(x))), lambda x: x <> ''), '|') AS items FROM part", "")
def list_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.list_items(F.replace("p_type", F.lit(" "), F.lit(" , "))), "|").alias("items"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown FROM documents", "")
def result_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 100).alias("shown"))


@query("SELECT event_id, array_to_string(list_filter(['value', 'true_label', 'stress_prob'], lambda k: k <> 'true_label'), ',') AS keys FROM events", "")
def leak_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("true_label"), F.lit("AF"), F.lit("stress_prob"), F.lit("0.1")).alias("m"))
    return made.select("event_id", F.array_join(F.map_keys(tx.without_leaks(F.col("m"), ["label"])), ",").alias("keys"))


@query("SELECT event_id, CASE WHEN subject_id % 2 = 0 THEN 'II,V1' ELSE 'aVR' END AS leads FROM m")
def leads_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("subject_id") % 2 == 0, "leads ii and V1, again II").otherwise("only AVR here")
    return windows(spark, sf_dir).select("event_id", F.array_join(tx.leads_named(text), ",").alias("leads"))
