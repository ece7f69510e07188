"""Sinks: replay lines, summary tables, analysis sets, reports, manifests, id lists and markdown summaries.

Tables are written by the executors; only what is bounded by the number of strata or lines of a report
goes into one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrain.operators.sequence import keep_last

#: Columns of the summary of several patients, in their order.
SUMMARY_FIELDS = "patient_id segment_id note eval_target windows_processed truth_af_windows truth_n_windows af_sensitivity n_specificity gt_transitions pred_transitions gt_episodes intervention_events matched_episodes missed_episodes false_alerts duplicate_alerts precision recall f1 latency_windows_mean latency_windows_median latency_seconds_mean truth_unknown_windows predicted_unknown_windows".split()


def replay_records(windows: DataFrame, interventions: DataFrame, contexts: DataFrame) -> DataFrame:
    """All records of a replay under one schema, each with its type: windows, interventions and final contexts."""
    tagged = [df.withColumn("record_type", F.lit(kind)) for kind, df in (("window", windows), ("intervention", interventions), ("patient_context", contexts))]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def context_alert(patient: str, at: str, urgency: str, rules: str, reason: str) -> Column:
    """An alert as a context holds it; what is missing has its default."""
    return F.struct(F.coalesce(patient, F.lit("")).alias("patient_id"), F.coalesce(F.col(at).cast("double"), F.lit(0.0)).alias("offset_s"), F.coalesce(urgency, F.lit("none")).alias("urgency"), F.coalesce(rules, F.array().cast("array<string>")).alias("triggered_rules"), F.coalesce(reason, F.lit("")).alias("reason"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON document a line; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """The summary of several patients as one CSV file with its fixed columns; those that are missing stay empty."""
    columns = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY_FIELDS]
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_analysis(failures: DataFrame, cause: str, path: str) -> None:
    """Failed samples as lines and as a table, and the number of each cause as one document."""
    write_lines(failures, f"{path}/lines")
    failures.write.mode("overwrite").option("header", True).csv(f"{path}/table")
    failures.groupBy(cause).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_reports(rows: DataFrame, key: str, path: str) -> None:
    """One folder of JSON a patient."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def write_manifest(strata: DataFrame, path: str) -> None:
    """A small aggregate as one document: its rows as a list and their sum."""
    strata.agg(F.array_sort(F.collect_list(F.struct(*strata.columns))).alias("strata"), F.sum("n").alias("total")).coalesce(1).write.mode("overwrite").json(path)


def write_ids(rows: DataFrame, column: str, path: str) -> None:
    """One id a line, in order."""
    rows.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """(line, value): a table of a small aggregate in markdown."""
    head = rows.sparkSession.createDataFrame([(-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + "---|" * len(rows.columns))], "line int, value string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("cells")))).alias("r"))
    return head.unionByName(ordered.select(F.posexplode(F.transform("r", lambda x: x["cells"])).alias("line", "value")))


def live_feed(rows: DataFrame, keys: list[str], order: list[str], discrete: Column, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """What a listener of each key still gets: the latest window, and the last `size` discrete events, older ones dropped."""
    return keep_last(rows, keys, order, 1), keep_last(rows.where(discrete), keys, order, size)
