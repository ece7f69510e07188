"""Alert rules as data, their evaluation, merging and de-duplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrain.schema import URGENCY

from .sequence import alert_edges


@dataclass(frozen=True)
class Rule:
    """A named condition over a tracker row with its urgency and reason."""

    rule_id: str
    urgency: str
    condition: str
    reason: str
    modalities: tuple[str, ...] = ("ecg", "ppg")
    staged: bool = False


#: Thresholds of the active and staged rules.
RULES = [
    Rule("extreme_bradycardia", "critical", "hr_bpm < 30 AND window_s >= 10", "Heart rate is below 30 bpm."),
    Rule("extreme_tachycardia", "critical", "hr_bpm > 200 AND window_s >= 10", "Heart rate is above 200 bpm."),
    Rule("sustained_tachycardia", "medium", "tachy_samples >= 30 AND tachy_ratio >= 0.80", "Heart rate stayed above 100 bpm."),
    Rule("long_af_episode", "high", "af_episode_s >= 86400", "An AF episode has lasted for a day.", staged=True),
]


def rules_for(modality: str, staged: bool = False, rules: list[Rule] = RULES) -> list[Rule]:
    return [r for r in rules if modality in r.modalities and (staged or not r.staged)]


def rank(urgency: Column) -> Column:
    """Place of an urgency in its order; unknown ones rank lowest."""
    return F.coalesce(F.create_map(*(F.lit(x) for k, u in enumerate(URGENCY) for x in (u, k)))[urgency], F.lit(0))


def urgency_of(place: Column) -> Column:
    return F.get(F.array(*(F.lit(u) for u in URGENCY)), place)


def evaluate(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds triggered (ids in registry order), urgency (the highest) and reason; a condition over nulls does not fire."""
    fires = [F.coalesce(F.expr(r.condition), F.lit(False)) for r in rules]
    ids = F.array_compact(F.array(*(F.when(f, F.lit(r.rule_id)) for f, r in zip(fires, rules, strict=True)))) if rules else F.array().cast("array<string>")
    reasons = F.array_compact(F.array(*(F.when(f, F.lit(r.reason)) for f, r in zip(fires, rules, strict=True)))) if rules else F.array().cast("array<string>")
    top = F.greatest(F.lit(0), *(F.when(f, URGENCY.index(r.urgency)).otherwise(0) for f, r in zip(fires, rules, strict=True))) if rules else F.lit(0)
    return rows.withColumns({"triggered": ids, "urgency": urgency_of(top), "reason": F.array_join(reasons, " ")})


def merge(first_ids: Column, first_urgency: Column, second_ids: Column, second_urgency: Column) -> tuple[Column, Column]:
    """Ordered distinct union of ids and the higher urgency."""
    return F.array_distinct(F.concat(first_ids, second_ids)), urgency_of(F.greatest(rank(first_urgency), rank(second_urgency)))


def judge_gate(hr: Column, rhythm: Column, irregular: Column, ratio: Column) -> Column:
    """Whether a row is worth a second opinion: rate off [50, 100], a rhythm other than N, irregular, or ratio from 0.5."""
    return F.coalesce((hr < 50) | (hr > 100), F.lit(False)) | F.coalesce(rhythm != "N", F.lit(False)) | F.coalesce(irregular, F.lit(False)) | F.coalesce(ratio >= 0.5, F.lit(False))


def alerts(evaluated: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First activation and every change of (rule set, urgency) while active."""
    return alert_edges(evaluated, keys, order, F.size("triggered") > 0, F.struct(F.array_sort("triggered").alias("ids"), F.col("urgency").alias("urgency")))


def first_triggers(evaluated: DataFrame, keys: list[str], at: str) -> DataFrame:
    return evaluated.select(*keys, at, F.explode("triggered").alias("rule_id")).groupBy(*keys, "rule_id").agg(F.min(at).alias("first_at"), F.count(F.lit(1)).alias("rows"))


def catalogue(rules: list[Rule] = RULES) -> list[tuple[str, str, str, str]]:
    return [(r.rule_id, r.urgency, r.condition, "staged" if r.staged else "active") for r in rules]
