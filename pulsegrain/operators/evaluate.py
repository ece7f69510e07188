"""Evaluation of detected transitions and alerts against annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_transitions(truth: DataFrame, predicted: DataFrame, keys: list[str], at: str, label: str) -> DataFrame:
    """Each true transition with the earliest later prediction of its label before the next true one, used once.

    The scoring intervals of one key are disjoint, so each prediction has one candidate: the latest true
    transition at or before it, found by carrying the truth forward over one sorted union.
    """
    t = truth.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(at).alias("at"), F.col(label).alias("label")).alias("_truth"), F.lit(None).cast(truth.schema[label].dataType).alias("_label"))
    p = predicted.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(t.schema["_truth"].dataType).alias("_truth"), F.col(label).alias("_label"))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = t.unionByName(p).withColumn("_truth", F.last("_truth", ignorenulls=True).over(w)).where("_kind = 1 AND _truth.label = _label")
    hits = carried.groupBy(*keys, F.col("_truth.at").alias(at)).agg(F.min("_t").alias("matched_at"))
    return truth.join(hits, [*keys, at], "left").withColumn("latency", F.col("matched_at") - F.col(at))


def match_alerts(episodes: DataFrame, alerts: DataFrame, keys: list[str], episode: str, bounds: tuple[str, str], at: str, alert_id: str, tolerance: int = 0) -> DataFrame:
    """Adds episode and outcome to each alert: hit (first of its episode), duplicate, or false (outside of all).

    With a tolerance an alert may precede its episode; where episodes overlap so, the earliest one takes it,
    however many begin within the tolerance.
    """
    start, end = bounds
    e = episodes.select(*keys, F.struct((F.col(start) - F.lit(tolerance)).alias("lo"), F.col(end).alias("hi"), F.col(episode).alias("id")).alias("_e")).where("_e.hi IS NOT NULL")
    # of the episodes that end after an alert the earliest begins first; one that ends no later than an earlier one is never it
    sofar = Window.partitionBy(*keys).orderBy("_e.lo", "_e.id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_top", F.max("_e.hi").over(sofar)).where("_top IS NULL OR _e.hi > _top").drop("_top")
    known = e.select(*keys, F.col("_e.hi").alias("_t"), F.lit(0).alias("_kind"), "_e", F.lit(None).cast(alerts.schema[alert_id].dataType).alias(alert_id))
    asked = alerts.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), alert_id)
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    marked = known.unionByName(asked).withColumn("_next", F.last("_e", ignorenulls=True).over(w))
    placed = marked.where("_kind = 1").select(*keys, alert_id, F.col("_t").alias(at), F.when(F.col("_t") >= F.col("_next.lo"), F.col("_next.id")).alias(episode))
    v = Window.partitionBy(*keys, episode).orderBy(at, alert_id)
    return placed.withColumn("outcome", F.when(F.col(episode).isNull(), "false").when(F.row_number().over(v) == 1, "hit").otherwise("duplicate"))


def precision_recall(matched: Column, truth: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where a denominator is 0."""
    p, r = F.coalesce(F.try_divide(matched, predicted), F.lit(0.0)), F.coalesce(F.try_divide(matched, truth), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def latency_summary(matches: DataFrame, keys: list[str], latency: str) -> DataFrame:
    v = F.col(latency)
    return matches.where(v.isNotNull()).groupBy(*keys).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90"), F.max(v).alias("max"), F.count(v).alias("n"))


def breakdown(truth: DataFrame, matched: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of all three by key; a key that any side has appears."""
    tag = lambda df, name: df.select(*keys, F.lit(name).alias("_side"))
    every = tag(truth, "truth").unionByName(tag(matched, "matched")).unionByName(tag(predicted, "predicted"))
    return every.groupBy(*keys).agg(*(F.count_if(F.col("_side") == s).alias(s) for s in ("truth", "matched", "predicted")))


def sensitivity_specificity(rows: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row per class over the rows whose truth is known."""
    known = rows.where(F.col(truth).isNotNull())
    each = known.withColumn("class", F.explode(F.array(*(F.lit(c) for c in classes))))
    t, p = F.col(truth) == F.col("class"), F.coalesce(F.col(predicted) == F.col("class"), F.lit(False))
    return each.groupBy("class").agg(F.try_divide(F.count_if(t & p), F.count_if(t)).alias("sensitivity"), F.try_divide(F.count_if(~t & ~p), F.count_if(~t)).alias("specificity"), F.count_if(t).alias("support"))
