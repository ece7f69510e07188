"""Catalogue, lookup and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.functions import vitals as vt
from pulsegrain.operators import catalogues as ct
from pulsegrain.operators import sequence as seq

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


_RECORDS = "SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 97 END AS age, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex FROM customer"


@query(f"SELECT c_custkey, age, sex FROM ({_RECORDS}) WHERE age >= 20 AND age <= 60 AND coalesce(sex = 'female', TRUE)", "")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 97 END AS age", "CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex")
    return ct.search(rows, "age", "sex", 20, 60, "female")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS classes FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY 1", "")
def diagnostic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_partkey").alias("p_partkey"))
    found = ct.classes_of(codes, table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey", "p_brand"), ["o_custkey"], "p_partkey", "p_brand")
    return found.select("o_custkey", F.array_join("classes", ",").alias("classes"))


@query("SELECT l_orderkey, p_brand, max(l_discount) AS best, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS labels FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL", "")
def concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    found = ct.best_per_concept(table(spark, sf_dir, "lineitem"), mapping, ["l_orderkey"], "l_partkey", "p_brand", "l_discount")
    return found.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query("""SELECT l_orderkey, l_linenumber, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R')::INT DESC, l_discount DESC, l_linenumber) AS r FROM
(SELECT *, max((l_discount >= 0.06)::INT) OVER (PARTITION BY l_orderkey) AS a FROM lineitem) WHERE l_discount >= 0.06 OR a = 0) WHERE r <= 2""", "")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.ranked_findings(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount", 0.06, 2, F.col("l_returnflag") == "R", "l_linenumber").select("l_orderkey", "l_linenumber", "rank")


_MANIFEST = "(VALUES (1, 'AUTOMOBILE', '3', 'a'), (2, '', '5', 'b'), (3, 'BUILDING', '', 'c'), (4, '', '', 'd'), (5, 'AUTOMOBILE', '', 'e'))"


@query(f"""SELECT seg, nat, arg_min(v, o) AS v FROM (SELECT DISTINCT c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS nat FROM customer) q LEFT JOIN {_MANIFEST} t(o, s, n, v) ON (s = '' OR s = seg) AND (n = '' OR n = nat) GROUP BY ALL""", "")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = spark.createDataFrame([(1, "AUTOMOBILE", "3", "a"), (2, "", "5", "b"), (3, "BUILDING", "", "c"), (4, "", "", "d"), (5, "AUTOMOBILE", "", "e")], "o int, seg string, nat string, v string")
    asked = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("string").alias("nat")).distinct()
    return ct.manifest_lookup(asked, manifest, ["seg", "nat"], "o", "v")


@query("""SELECT o_orderkey, coalesce(c_name, 'none') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey""", "")
def state_context_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("none")).alias("name"))


@query("""SELECT subject_id, coalesce(sum(d) FILTER (event_type = 'purchase'), 0)::BIGINT AS duration, round(coalesce(sum(d) FILTER (event_type = 'purchase'), 0) / sum(d), 9) AS burden,
max_by(event_type, (d, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END)) AS dominant FROM (SELECT subject_id, event_type, sum(dur_us) AS d FROM m WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY ALL) WHERE d IS NOT NULL GROUP BY ALL""")
def subject_label_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ct.label_aggregates(windows(spark, sf_dir).where("dur_us IS NOT NULL"), ["subject_id"], "event_type", "dur_us", "purchase", {"purchase": 3, "signup": 2, "view": 1})
    return found.withColumn("burden", F.round("burden", 9))


_RUNS = """, k AS (SELECT *, CASE WHEN lag(rhythm_class) OVER w IS DISTINCT FROM rhythm_class OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS run FROM k),
ep AS (SELECT subject_id, rhythm_class, run, count(*) AS n, max(end_us) - min(off_us) AS d FROM r WHERE rhythm_class IN ('AF', 'Other') GROUP BY ALL)"""


@query("SELECT subject_id, rhythm_class, count(*) AS episodes, round(avg(d), 3) AS mean_duration, max(n) AS top_rank FROM ep GROUP BY ALL", SQL + _RUNS)
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.episodes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", ["AF", "Other"], "off_us", "end_us").withColumn("d", F.col("run_end") - F.col("run_start"))
    return ct.episode_summary(found, ["subject_id"], "rhythm_class", "d", "run_rows").withColumn("mean_duration", F.round("mean_duration", 3))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value < 100) AS successes, round(sum(value), 2) AS total, max(value) AS slowest, round(avg(value), 6) AS mean FROM events GROUP BY ALL", "")
def trace_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ct.trace_performance(table(spark, sf_dir, "events"), "event_type", F.col("value") < 100, "value")
    return found.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("""SELECT c, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN 'tool_error' WHEN value < 5 THEN 'missing_data' WHEN value < 10 THEN 'no_answer' WHEN value < 50 THEN 'wrong_answer' END AS c FROM events)
WHERE c IS NOT NULL GROUP BY GROUPING SETS ((c), (c, event_type))""", "")
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cause = ct.failure_attribution(F.col("event_type") == "error", F.col("value") < 5, F.col("value") >= 10, F.col("value") >= 50)
    rows = table(spark, sf_dir, "events").select("event_type", cause.alias("c")).where("c IS NOT NULL")
    return rows.groupingSets([[F.col("c")], [F.col("c"), F.col("event_type")]], F.col("c"), F.col("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT subject_id, round((lg / 1e6) / 86400, 9) AS hours, af, round(af / lg::DOUBLE, 9) AS fraction FROM (SELECT subject_id, sum(dur_us)::BIGINT AS lg, coalesce(sum(CASE WHEN rhythm_class = 'AF' THEN dur_us END), 0)::BIGINT AS af FROM m GROUP BY ALL)")
def recording_af_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = windows(spark, sf_dir).groupBy("subject_id").agg(F.sum("dur_us").alias("lg"), F.coalesce(F.sum(F.when(F.col("rhythm_class") == "AF", F.col("dur_us"))), F.lit(0)).alias("af"))
    return grouped.select("subject_id", F.round(F.col("lg") / 1e6 / 86400, 9).alias("hours"), "af", F.round(F.try_divide("af", "lg"), 9).alias("fraction"))


@query("SELECT subject_id, count(*) AS chunks, max(n) AS longest, sum(n)::BIGINT AS total, array_to_string(list(n ORDER BY recording_id), ',') AS sizes FROM (SELECT subject_id, recording_id, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = windows(spark, sf_dir).groupBy("subject_id", "recording_id").agg(F.count(F.lit(1)).alias("n"))
    grouped = chunks.groupBy("subject_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("longest"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("recording_id", "n"))).alias("l"))
    return grouped.select("subject_id", "chunks", "longest", "total", F.array_join(F.transform("l", lambda v: v["n"].cast("string")), ",").alias("sizes"))


@query("SELECT event_id, off_us - lag(end_us) OVER w AS gap, row_number() OVER w - 1 AS place FROM m WHERE event_type <> 'view' WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)")
def window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.gaps(windows(spark, sf_dir).where("event_type <> 'view'"), ["subject_id"], ORDER, "off_us", "end_us").select("event_id", "gap", "place")


@query("SELECT subject_id, round(15 + 10 * ((t - 30) / 59), 6) AS eleventh FROM (SELECT subject_id, (max(off_us) - min(off_us)) / 1e6 AS t FROM m GROUP BY ALL)")
def chunk_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = windows(spark, sf_dir).groupBy("subject_id").agg(((F.max("off_us") - F.min("off_us")) / 1e6).alias("t"))
    return spans.select("subject_id", F.round(F.get(ct.sample_centres(F.col("t"), 60), F.lit(10)), 6).alias("eleventh"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'below' WHEN value > 100 THEN 'above' ELSE 'within' END AS flag, greatest(1, round_even(value * 2.5, 0))::BIGINT AS samples FROM events", "")
def range_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", vt.range_flag(v, 20, 100).alias("flag"), vt.samples_for(v, F.lit(2.5)).alias("samples"))


@query("SELECT state_id, doc FROM (SELECT event_id AS state_id, CASE WHEN rhythm_class IS NULL THEN '{\"event_id\":' || event_id || '}' ELSE '{\"event_id\":' || event_id || ',\"rhythm_class\":\"' || rhythm_class || '\"}' END AS doc FROM m)")
def compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted fields as JSON: nulls are left out."""
    return windows(spark, sf_dir).select(F.col("event_id").alias("state_id"), F.to_json(F.struct("event_id", "rhythm_class")).alias("doc"))


@query("""SELECT subject_id, recording_id, mode AS label, fraction FROM (SELECT subject_id, recording_id, arg_min(k, (-c, k)) AS mode, max(c) / sum(c) AS fraction FROM (SELECT subject_id, recording_id,
CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS k, count(*) AS c FROM m GROUP BY ALL) GROUP BY ALL) WHERE fraction >= 0.5 AND mode <> 0""")
def clean_label_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose dominant label is allowed and holds at least half of them."""
    from pulsegrain.operators.intervals import mode_smallest

    k = F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END")
    found = mode_smallest(windows(spark, sf_dir).withColumn("k", k), ["subject_id", "recording_id"], "k")
    return found.where("fraction >= 0.5 AND mode <> 0").select("subject_id", "recording_id", F.col("mode").alias("label"), "fraction")
