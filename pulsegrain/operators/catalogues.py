"""Catalogue search, dimension lookups, failure attribution and summaries of episodes, alerts and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(records: DataFrame, age: str, sex: str, low: float | None, high: float | None, wanted_sex: str | None) -> DataFrame:
    """Age range and sex: an unknown age fails a bound, an unknown sex passes."""
    found = records
    if low is not None:
        found = found.where(F.coalesce(F.col(age) >= low, F.lit(False)))
    if high is not None:
        found = found.where(F.coalesce(F.col(age) <= high, F.lit(False)))
    return found if wanted_sex is None else found.where(F.coalesce(F.col(sex) == wanted_sex, F.lit(True)))


def classes_of(codes: DataFrame, dimension: DataFrame, keys: list[str], code: str, name: str) -> DataFrame:
    """The distinct sorted classes of each record's codes; codes without a class are left out."""
    return codes.join(dimension, code).groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("classes"))


def best_per_concept(predictions: DataFrame, mapping: DataFrame, keys: list[str], label: str, concept: str, score: str) -> DataFrame:
    """Highest score of each concept and the labels behind it."""
    return predictions.join(mapping, label).groupBy(*keys, concept).agg(F.max(score).alias("best"), F.array_sort(F.collect_set(label)).alias("labels"))


def ranked_findings(findings: DataFrame, keys: list[str], score: str, least: float, top: int, preferred: Column, tie: str) -> DataFrame:
    """Findings above a threshold, preferred scope first, then by score; all of a key's findings where none passes."""
    every = Window.partitionBy(*keys)
    passes = F.col(score) >= least
    kept = findings.withColumn("_any", F.max(passes.cast("int")).over(every)).where(passes | (F.col("_any") == 0)).drop("_any")
    w = Window.partitionBy(*keys).orderBy(F.desc(preferred.cast("int")), F.desc(score), tie)
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def manifest_lookup(requests: DataFrame, manifest: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The first manifest entry that fits: an empty key of the entry fits anything.

    Each combination of empty keys is one equi join, so that no pair is formed that does not fit.
    """
    found = None
    for mask in range(1 << len(keys)):
        named = [k for n, k in enumerate(keys) if not mask >> n & 1]
        part = manifest
        for n, k in enumerate(keys):
            part = part.where(F.coalesce(F.col(k), F.lit("")) == "") if mask >> n & 1 else part.where(F.coalesce(F.col(k), F.lit("")) != "")
        part = part.select(*named, F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_m"))
        hit = requests.join(part, named) if named else requests.crossJoin(F.broadcast(part.agg(F.min("_m").alias("_m"))).where("_m IS NOT NULL"))
        hit = hit.select(*requests.columns, "_m")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(*requests.columns).agg(F.min("_m").alias("_m"))
    return requests.join(best, requests.columns, "left").select(*requests.columns, F.col("_m.v").alias(value))


def label_aggregates(rows: DataFrame, keys: list[str], label: str, duration: str, wanted: str, priority: dict[str, int]) -> DataFrame:
    """Burden and duration of a label and the dominant one by duration (ties by priority)."""
    place = F.coalesce(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col(label)], F.lit(-1))
    each = rows.where(F.col(label).isin(list(priority))).groupBy(*keys, label).agg(F.sum(duration).alias("d"))
    hit = F.coalesce(F.sum(F.when(F.col(label) == wanted, F.col("d"))), F.lit(0))
    return each.groupBy(*keys).agg(hit.alias("duration"), F.try_divide(hit, F.sum("d")).alias("burden"), F.max_by(label, F.struct("d", place)).alias("dominant"))


def episode_summary(episodes: DataFrame, keys: list[str], kind: str, duration: str, rank: str) -> DataFrame:
    return episodes.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("episodes"), F.avg(duration).alias("mean_duration"), F.max(rank).alias("top_rank"))


def alert_summary(alerts: DataFrame, keys: list[str], outcome: str, at: str) -> DataFrame:
    o = F.col(outcome)
    return alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(o == "false").alias("false_alerts"), F.count_if(o == "hit").alias("matched"), F.max(at).alias("last_at"))


def trace_performance(events: DataFrame, tool: str, success: Column, duration: str) -> DataFrame:
    return events.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.count_if(success).alias("successes"), F.sum(duration).alias("total"), F.max(duration).alias("slowest"), F.avg(duration).alias("mean"))


def failure_attribution(error: Column, missing: Column, answered: Column, score: Column) -> Column:
    """Why a sample failed: call error, missing data, no answer, wrong answer; null for a success."""
    return F.when(F.coalesce(error, F.lit(False)), "tool_error").when(F.coalesce(missing, F.lit(False)), "missing_data").when(~F.coalesce(answered, F.lit(False)), "no_answer").when(~F.coalesce(score, F.lit(False)), "wrong_answer")


def sample_centres(total_s: Column, n: int, margin: float = 15.0) -> Column:
    """n centres (10 to 200 of them) evenly from the margin to the end less the margin."""
    n = min(max(n, 10), 200)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(margin) + k * (total_s - 2 * margin) / (n - 1))


def gaps(windows: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Adds gap to the window before and its id position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return windows.withColumn("gap", F.col(start) - F.lag(end).over(w)).withColumn("place", F.row_number().over(w) - 1)
