"""Evaluation and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.operators import evaluate as ev
from pulsegrain.operators import sampling as sm
from pulsegrain.operators import sequence as seq

from .testdata_model import ORDER, SQL, table, windows

QUERIES: dict = {}
ORACLE_SQL: dict = {}
HOUR = 3_600_000_000


def query(sql: str | None, prefix: str = SQL):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = prefix + sql
        return function

    return register


_PRED = "CASE WHEN value > 300 THEN 'AF' WHEN value > 150 THEN 'Other' ELSE 'N' END"
_EVENTS = f""", gt AS (SELECT subject_id, off_us, f AS from_label, rhythm_class AS to_label FROM (SELECT *, lag(rhythm_class) OVER w AS f FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)) WHERE f <> rhythm_class),
pr AS (SELECT subject_id, off_us, f AS from_label, p AS to_label FROM (SELECT *, lag(p) OVER w AS f FROM (SELECT *, {_PRED} AS p FROM m) WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)) WHERE f <> p),
mt AS (SELECT g.subject_id, g.off_us, g.from_label, g.to_label, min(p.off_us) AS matched_at, min(p.off_us) - g.off_us AS latency
FROM (SELECT *, coalesce(lead(off_us) OVER (PARTITION BY subject_id ORDER BY off_us), 9223372036854775807) AS nx FROM gt) g LEFT JOIN pr p ON p.subject_id = g.subject_id AND p.to_label = g.to_label AND p.off_us >= g.off_us AND p.off_us < g.nx GROUP BY g.subject_id, g.off_us, g.from_label, g.to_label)"""


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = windows(spark, sf_dir).withColumn("predicted", F.when(F.col("value") > 300, "AF").when(F.col("value") > 150, "Other").otherwise("N"))
    pick = lambda label: seq.changes(rows, ["subject_id"], ORDER, label, bridge=False).select("subject_id", "off_us", "from_label", "to_label")
    return pick("rhythm_class"), pick("predicted")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = _events(spark, sf_dir)
    return ev.match_transitions(truth, predicted, ["subject_id"], "off_us", "to_label")


@query("SELECT subject_id, off_us, to_label, matched_at, latency FROM mt", SQL + _EVENTS)
def match_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("subject_id", "off_us", "to_label", "matched_at", "latency")


_REPORT = """SELECT {0}round(coalesce(k / nullif(p, 0), 0), 9) AS precision, round(coalesce(k / nullif(t, 0), 0), 9) AS recall, round(coalesce(2 * k / nullif(p + t, 0), 0), 9) AS f1"""


@query(_REPORT.format("") + " FROM (SELECT (SELECT count(*) FROM mt WHERE matched_at IS NOT NULL) AS k, (SELECT count(*) FROM gt) AS t, (SELECT count(*) FROM pr) AS p)", SQL + _EVENTS)
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = _events(spark, sf_dir)
    hits = ev.match_transitions(truth, predicted, ["subject_id"], "off_us", "to_label").where("matched_at IS NOT NULL")
    counts = ev.breakdown(truth.withColumn("all", F.lit(1)), hits.withColumn("all", F.lit(1)), predicted.withColumn("all", F.lit(1)), ["all"])
    p, r, f1 = ev.precision_recall(F.col("matched"), F.col("truth"), F.col("predicted"))
    return counts.select(F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


@query("""SELECT coalesce(a.from_label, b.from_label) AS from_label, coalesce(a.to_label, b.to_label) AS to_label, coalesce(t, 0) AS truth, coalesce(k, 0) AS matched, coalesce(p, 0) AS predicted
FROM (SELECT from_label, to_label, count(*) AS t, count(matched_at) AS k FROM mt GROUP BY ALL) a FULL JOIN (SELECT from_label, to_label, count(*) AS p FROM pr GROUP BY ALL) b ON a.from_label = b.from_label AND a.to_label = b.to_label""", SQL + _EVENTS)
def per_pair_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = _events(spark, sf_dir)
    hits = ev.match_transitions(truth, predicted, ["subject_id"], "off_us", "to_label").where("matched_at IS NOT NULL")
    return ev.breakdown(truth, hits, predicted, ["from_label", "to_label"])


@query("SELECT to_label, round(avg(latency), 3) AS mean, round(quantile_cont(latency, 0.5), 3) AS median, round(quantile_cont(latency, 0.9), 3) AS p90, max(latency) AS max, count(latency) AS n FROM mt WHERE latency IS NOT NULL GROUP BY ALL", SQL + _EVENTS)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.latency_summary(_matched(spark, sf_dir), ["to_label"], "latency")
    return found.withColumns({c: F.round(c, 3) for c in ("mean", "median", "p90")})


_RUNS = """, k AS (SELECT *, CASE WHEN lag(rhythm_class) OVER w IS DISTINCT FROM rhythm_class OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY off_us, event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY subject_id ORDER BY off_us, event_id) AS run FROM k),
ep AS (SELECT subject_id, run, min(off_us) AS run_start, max(end_us) AS run_end, row_number() OVER (PARTITION BY subject_id ORDER BY run) - 1 AS episode FROM r WHERE rhythm_class IN ('AF', 'Other') GROUP BY subject_id, run, rhythm_class),
al AS (SELECT subject_id, off_us, event_id FROM m WHERE hr_bpm > 200),
ma AS (SELECT al.subject_id, al.event_id, al.off_us, min(episode) AS episode FROM al LEFT JOIN ep ON al.subject_id = ep.subject_id AND al.off_us >= run_start - {tolerance} AND al.off_us < run_end GROUP BY ALL)
SELECT subject_id, event_id, episode, CASE WHEN episode IS NULL THEN 'false' WHEN row_number() OVER (PARTITION BY subject_id, episode ORDER BY off_us, event_id) = 1 THEN 'hit' ELSE 'duplicate' END AS outcome FROM ma"""


def _alerts(spark: SparkSession, sf_dir: str, tolerance: int) -> DataFrame:
    rows = windows(spark, sf_dir)
    found = seq.episodes(rows, ["subject_id"], ORDER, "rhythm_class", ["AF", "Other"], "off_us", "end_us").withColumn("episode", F.col("episode").cast("long"))
    return ev.match_alerts(found, rows.where("hr_bpm > 200"), ["subject_id"], "episode", ("run_start", "run_end"), "off_us", "event_id", tolerance).select("subject_id", "event_id", "episode", "outcome")


@query(_RUNS.replace("{tolerance}", "0"))
def match_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir, 0)


@query(_RUNS.replace("{tolerance}", str(HOUR)))
def match_interventions_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts up to an hour before onset count for the episode."""
    return _alerts(spark, sf_dir, HOUR)


@query(f"SELECT subject_id, episode FROM ep WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.subject_id = ep.subject_id AND al.off_us >= run_start AND al.off_us < run_end)", SQL + _RUNS.replace("{tolerance}", "0").partition("SELECT subject_id, event_id, episode, CASE")[0])
def missed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.episodes(windows(spark, sf_dir), ["subject_id"], ORDER, "rhythm_class", ["AF", "Other"], "off_us", "end_us").withColumn("episode", F.col("episode").cast("long"))
    return found.join(_alerts(spark, sf_dir, 0).where("outcome = 'hit'"), ["subject_id", "episode"], "left_anti").select("subject_id", "episode")


@query(f"""SELECT c AS class, round(count(*) FILTER (rhythm_class = c AND p = c) / nullif(count(*) FILTER (rhythm_class = c), 0), 9) AS sensitivity,
round(count(*) FILTER (rhythm_class <> c AND p <> c) / nullif(count(*) FILTER (rhythm_class <> c), 0), 9) AS specificity, count(*) FILTER (rhythm_class = c) AS support
FROM (SELECT *, {_PRED} AS p FROM m WHERE rhythm_class IS NOT NULL), (VALUES ('N'), ('AF'), ('Other')) v(c) GROUP BY ALL""")
def sensitivity_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).withColumn("predicted", F.when(F.col("value") > 300, "AF").when(F.col("value") > 150, "Other").otherwise("N"))
    found = ev.sensitivity_specificity(rows, "rhythm_class", "predicted", ["N", "AF", "Other"])
    return found.withColumns({c: F.round(c, 9) for c in ("sensitivity", "specificity")})


# --- sampling over documents ------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", "")
def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents in the order of a seeded draw."""
    drawn = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id")
    return sm.ranked(drawn.withColumn("stratum", F.lit(1)), ["stratum"], 42, "doc_id").select("doc_id", F.col("_n").alias("place"))


@query("""WITH q AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS place, count(*) OVER () AS strata FROM (SELECT DISTINCT lang FROM documents))
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS n FROM documents) JOIN q USING (lang) WHERE n <= 278 // strata + (place < 278 % strata)::INT""", "")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 278, 42, "doc_id").select("doc_id", "lang")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY sha256('7:' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY lang, source) * 0.3) THEN 'dev' ELSE 'test' END AS split FROM documents""", "")
def dev_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 0.3, 7, "doc_id").select("doc_id", "split")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('1:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5", "")
def per_target_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], 5, 1, "doc_id").select("doc_id", "source")


@query("""SELECT source, n > greatest(t - round_even(t * 0.7, 0), 1) AS preloaded FROM (SELECT source, row_number() OVER (ORDER BY sha256('3:' || source), source) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT source FROM documents))""", "")
def preload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.preload(table(spark, sf_dir, "documents").select("source").distinct(), 0.7, 3, "source").select("source", "preloaded")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10", "")
def top10_slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("""SELECT id, kind FROM (SELECT s_suppkey AS id, 'supplier' AS kind, 0 AS p FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT c_custkey, 'customer', 1 FROM customer) ORDER BY p, id LIMIT 60""", "")
def federated_union_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return sm.union_by_priority([first, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))], ["id"], 60)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)", "")
def composition_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n, grouping(lang) AS g_lang, grouping(source) AS g_source FROM documents GROUP BY GROUPING SETS ((lang), (source), ())", "")
def statistics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.grouping("lang").cast("long").alias("g_lang"), F.grouping("source").cast("long").alias("g_source"))
    return out


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 10", "")
def unique_id_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.duplicates(table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT coalesce(a.lang, b.lang) AS lang, coalesce(x, 0) AS left_n, coalesce(y, 0) AS right_n FROM (SELECT lang, count(*) AS x FROM documents GROUP BY 1) a
FULL JOIN (SELECT lang, count(*) AS y FROM documents WHERE n_chars > 500 OR lang = 'de' GROUP BY 1) b ON a.lang = b.lang WHERE coalesce(x, 0) <> coalesce(y, 0)""", "")
def stratum_totals_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sm.same_totals(docs, docs.where("n_chars > 500 OR lang = 'de'"), ["lang"])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels", "")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0", "")
def leak_guard_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("SELECT p_type AS label FROM part UNION SELECT c_mktsegment FROM customer", "")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", "")
def referenced_states_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS missing FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)", "")
def unreferenced_states_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""", "")
def dimension_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes looked up through a chain of dimensions."""
    t = lambda n: table(spark, sf_dir, n)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "")
def extension_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: every combination of groupings."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
